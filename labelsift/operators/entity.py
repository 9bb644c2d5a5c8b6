"""From judgements to entities: keys, best rows, group maxima, conflicts. All use one partitioning, by the key."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelsift.functions.numeric import flag


def account_key(name: str | Column, created: str | Column) -> Column:
    """name|created of the raw texts; null reads as 'nan'."""
    name, created = (F.col(c) if isinstance(c, str) else c for c in (name, created))
    return F.concat_ws("|", F.coalesce(name, F.lit("nan")), F.coalesce(created, F.lit("nan")))


def distinct_with_null(x: str) -> Column:
    """Distinct values, null counted as one."""
    return F.count_distinct(x) + F.coalesce(F.max(F.col(x).isNull().cast("int")), F.lit(0))


def dependency_violations(df: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """(attribute, keys): keys that have more than one value (null included) of the attribute; 0 rows' worth is a row of 0."""
    per = df.groupBy(key).agg(*[distinct_with_null(a).alias(a) for a in attributes])
    one = per.agg(*[F.count_if(F.col(a) > 1).alias(a) for a in attributes])
    return one.unpivot([], attributes, "attribute", "keys")


def with_group_size(df: DataFrame, key: str, name: str = "n_rows") -> DataFrame:
    return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(key)))


def best_rows(df: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """The whole row of highest score for each key; null scores last, ties to the least ``tie``."""
    order = Window.partitionBy(key).orderBy(F.col(score).desc_nulls_last(), tie)
    return df.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def best_with_maxima(df: DataFrame, key: str, score: str, tie: str, maxima: list[str]) -> DataFrame:
    """best_rows with some columns replaced by the key's greatest values, in the same shuffle."""
    group = Window.partitionBy(key)
    raised = df.withColumns({c: F.max(c).over(group) for c in maxima})
    return best_rows(raised, key, score, tie)


def conflict_flag(key: str, value: str) -> Column:
    """1 on every row of a key that has more than one distinct non-null value."""
    group = Window.partitionBy(key)
    return flag(F.min(value).over(group) != F.max(value).over(group))


def conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Every row of every conflicting key."""
    return df.withColumn("_c", conflict_flag(key, value)).where("_c = 1").drop("_c")


def leave_one_out(df: DataFrame, group: str | list[str], condition: Column, counted: Column) -> DataFrame:
    """``df`` with others_n and others_hits: rows of the group, this one left out, that are ``counted``, and of these those with
    ``condition``."""
    keys = [group] if isinstance(group, str) else group
    n, hit = flag(counted).cast("long"), flag(counted & condition).cast("long")
    # a few hot groups hold all rows: sums are made before the shuffle, and come back by a join
    rows = df.withColumn("_n", n).withColumn("_hit", hit)
    sums = rows.groupBy(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]).agg(F.sum("_n").alias("_all_n"), F.sum("_hit").alias("_all_hits"))
    same = [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
    out = rows.join(sums, reduce(and_, same)).withColumn("others_n", F.col("_all_n") - F.col("_n")).withColumn("others_hits", F.col("_all_hits") - F.col("_hit"))
    return out.drop("_n", "_hit", "_all_n", "_all_hits", *[f"_g{i}" for i in range(len(keys))])
