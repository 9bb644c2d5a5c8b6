"""Splits, folds and samples by a hash of the key: the same on every run, engine and partitioning."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F


def hashed(key: str | Column, seed: int) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def ranked(df: DataFrame, key: str, seed: int, stratum: list[str] | None = None) -> DataFrame:
    """``df`` with _rank (from 1) and _size within the stratum, in order of the hash, then the key.

    A stratum is cut into 4,096 ranges of the hash; what its earlier ranges hold is where a range's ranks begin. So no
    task sorts a whole stratum.
    """
    stratum = stratum or []
    rows = df.withColumn("_h", hashed(key, seed)).withColumn("_range", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    own = Window.partitionBy(*[f"_s{i}" for i in range(len(stratum))])
    counts = rows.groupBy(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(stratum)], F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(own.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_before", before).withColumn("_size", F.sum("_c").over(own))
    same = [F.col("_range").eqNullSafe(F.col("_r")), *[F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(stratum)]]
    placed = rows.join(starts, reduce(and_, same))
    within = Window.partitionBy("_range", *stratum).orderBy("_h", key)
    return placed.withColumn("_rank", F.col("_before") + F.row_number().over(within)).select(*df.columns, "_rank", "_size")


def split(df: DataFrame, key: str, test_share: float, seed: int, stratum: list[str] | None = None) -> DataFrame:
    """``df`` with ``part``: 'test' for the first round(share * size) of each stratum, else 'train'."""
    out = ranked(df, key, seed, stratum)
    return out.withColumn("part", F.when(F.col("_rank") <= F.bround(F.col("_size") * test_share), "test").otherwise("train")).drop("_rank", "_size")


def folds(df: DataFrame, key: str, k: int, seed: int, stratum: list[str] | None = None) -> DataFrame:
    """``df`` with ``fold`` 0 to k - 1, even within each stratum."""
    return ranked(df, key, seed, stratum).withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_size")


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows, each set of n as likely: a top-n by hash, without a full sort."""
    return df.orderBy(hashed(key, seed), key).limit(n)


def stratified_sample(df: DataFrame, key: str, share: float, seed: int, stratum: list[str]) -> DataFrame:
    """round(share * size) rows of each stratum."""
    out = ranked(df, key, seed, stratum)
    return out.where(F.col("_rank") <= F.bround(F.col("_size") * share)).drop("_rank", "_size")


def group_split(df: DataFrame, group: str, test_share: float, seed: int) -> DataFrame:
    """``df`` with ``part`` decided by the group's hash alone, so that no group is on both sides; needs no shuffle."""
    unit = F.conv(F.substring(hashed(group, seed), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return df.withColumn("part", F.when(unit < test_share, "test").otherwise("train"))
