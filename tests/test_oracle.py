"""Every query of the library that SQL can express, against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from labelsift.plans import analytics, models, relational

DATA = Path("/root/testdata/sf0.001")
QUERIES = {**relational.QUERIES, **analytics.QUERIES, **models.QUERIES}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    return c


def normal(rows, names, order):
    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
        return str(v)

    return sorted(tuple(one(r[names.index(c)]) for c in order) for r in rows)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name,source", [("so_multi_key", "orders"), ("so_by_expression", "customer")])
def test_all_rows_in_order(spark, con, name, source):
    got = [tuple(r) for r in QUERIES[name][0](spark, str(DATA)).collect()]
    assert got == con.execute(QUERIES[name][1]).fetchall() and len(got) == con.execute(f"SELECT count(*) FROM {source}").fetchone()[0]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_matches_sql(spark, con, name):
    plan, sql = QUERIES[name]
    df = plan(spark, str(DATA))
    result = con.execute(sql)
    names, order = [d[0] for d in result.description], sorted(df.columns)
    assert sorted(names) == order
    assert normal([tuple(r) for r in df.collect()], df.columns, order) == normal(result.fetchall(), names, order)
