"""Exact deduplication by a tree merge of sorted digest runs.

Every document belongs to one of R runs (R a power of the radix). A run is sorted by digest and reduced to
one row per text, its keeper. In each round, runs whose numbers differ in one digit (base radix) exchange rows: a
row moves to the run that has, at this digit, the digit of the text's digest. A run's task merges what it is sent in order of the digests, by one
sorted pass that holds a single row, and equal texts that meet become one row. After log_radix(R) rounds, a run's number is its digest's last digits, so all copies of a
text have met. A group of any size is down to one row a run before the first exchange, so
no task ever holds a hot group, and only digests travel, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from labelsift.llm.common import ascii_lower, materialize, table

RADIX = 4
#: Documents that a run should have at least, so that few documents make few runs.
RUN_ROWS = 10_000
KEY = ["text_sha256", "_check", "_bytes"]


def run_count(partitions: int, radix: int = RADIX, most: int = 4096) -> int:
    """Smallest power of the radix that is at least the number of partitions, up to ``most``."""
    n = radix
    while n < min(partitions, most):
        n *= radix
    return n


def _merge(rows: DataFrame, runs: int, keep: str) -> DataFrame:
    """Rows (_run, key, keep_id, group_size) dealt to their runs, merged in order, equal keys of a run made one. A null id is kept only without another."""
    order = F.col("keep_id").asc_nulls_last() if keep == "min" else F.col("keep_id").asc_nulls_first()

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last key's row so far: the next batch may have more of it
        for batch in batches:
            table_ = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            n = table_.num_rows
            if not n:
                continue
            new = np.ones(n, bool)
            for name in ("_run", *KEY) if n > 1 else ():
                column = table_.column(name).chunk(0)
                equal = pc.equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                new[1:] = equal if name == "_run" else new[1:] & equal
            new[1:] = ~new[1:]
            starts = np.flatnonzero(new)
            sizes = np.add.reduceat(table_.column("group_size").to_numpy(), starts)
            kept = starts if keep == "min" else np.append(starts[1:], n) - 1
            out = table_.take(pa.array(kept)).set_column(table_.schema.get_field_index("group_size"), table_.schema.field("group_size"), pa.array(sizes, pa.int64()))
            out = out.combine_chunks().to_batches()[0]
            held = out.slice(out.num_rows - 1)
            yield out.slice(0, out.num_rows - 1)
        if held is not None:
            yield held

    columns = ["_run", *KEY, "keep_id", "group_size"]
    ready = rows.select(*columns).repartition(runs, "_run").sortWithinPartitions("_run", *KEY, order)
    return ready.mapInArrow(collapse, ready.schema)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", runs: int | None = None, radix: int = RADIX) -> DataFrame:
    """One row per row of ``docs``: the id, keep_id, group_size, kept and text_sha256.

    Texts are equal when equal after lower-casing A-Z; null counts as empty. Equality is by SHA-256 and is
    verified at every merge by a second hash and the length in bytes. ``keep``: "min" or "max" of the ids stays.
    A null id stays only in a group that has no other; rows repeated with one id are one document and share
    their decision. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    digests = materialize(
        docs.select(F.col(id_col).alias("_id"), text.alias("_t")).select(
            "_id",
            F.sha2("_t", 256).alias("text_sha256"),
            F.xxhash64("_t").alias("_check"),
            F.octet_length("_t").alias("_bytes"),
        ),
        "digests",
    )
    runs = runs or run_count(min(int(spark.conf.get("spark.sql.shuffle.partitions")), digests.count() // RUN_ROWS), radix)
    digests = digests.withColumn("_run", F.pmod(F.xxhash64(F.col("_id"), F.lit("run")), F.lit(runs)).cast("int"))
    first = _merge(digests.select("_run", *KEY, F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")), runs, keep)
    digest = F.conv(F.substring("text_sha256", 1, 8), 16, 10).cast("long")
    merged, place = first, 1
    while place < runs:
        mine = (F.col("_run") / place).cast("long") % radix
        theirs = (digest / place).cast("long") % radix
        merged = _merge(merged.withColumn("_run", (F.col("_run") + (theirs - mine) * place).cast("int")), runs, keep)
        place *= radix
    copies = merged.where("group_size > 1").select(*KEY, "keep_id", "group_size")
    # back down the tree: first to the runs that hold a copy (at most R rows a group), then to their rows
    held = digests.select("_run", *KEY).distinct().join(copies, KEY)
    result = digests.join(held, ["_run", *KEY], "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    return result.select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="max")


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
