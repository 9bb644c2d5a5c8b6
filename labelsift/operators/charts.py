"""The data behind charts: histograms, buckets, hexagonal bins, cumulative bars, missing shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def histogram(df: DataFrame, x: str, bins: int) -> DataFrame:
    """(bin from 0, low, high, n) over equal widths; the last bin holds the greatest value, empty bins show 0."""
    edge = df.agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(x) - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    counts = df.where(F.col(x).isNotNull()).crossJoin(F.broadcast(edge)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = edge.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = every.select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"))
    return out.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


#: Fixed value: group sizes shown as bars.
SIZE_BUCKETS = ("1", "2", "3", "4-9", "10+")


def size_bucket(n: Column) -> Column:
    return F.when(n <= 3, n.cast("string")).when(n <= 9, "4-9").otherwise("10+")


def group_size_buckets(df: DataFrame, key: str) -> DataFrame:
    """(bucket, groups)."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(size_bucket(F.col("n")).alias("bucket")).agg(F.count(F.lit(1)).alias("groups"))


def missing_shares(df: DataFrame) -> DataFrame:
    """(column, missing_pct), one aggregate."""
    one = df.agg(*[(100.0 * F.avg(F.col(c).isNull().cast("double"))).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column", "missing_pct")


def hexbin(df: DataFrame, x: str, y: str, across: int, least: int = 8, value: str | None = None) -> DataFrame:
    """(i, j, n[, mean]) of hexagonal cells with ``least`` points or more, ``across`` cells over x. A point goes to the nearer of two offset lattices."""
    edge = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    down = max(1, int(across / 3**0.5))
    px = (F.col(x) - F.col("x0")) / (F.col("x1") - F.col("x0")) * across
    py = (F.col(y) - F.col("y0")) / (F.col("y1") - F.col("y0")) * down
    points = df.crossJoin(F.broadcast(edge)).withColumn("px", px).withColumn("py", py)
    i1, j1, i2, j2 = F.round("px"), F.round("py"), F.floor("px"), F.floor("py")
    near = (F.col("px") - i1) ** 2 + 3 * (F.col("py") - j1) ** 2 < (F.col("px") - i2 - 0.5) ** 2 + 3 * (F.col("py") - j2 - 0.5) ** 2
    cell = points.withColumn("i", F.when(near, i1).otherwise(i2 + 0.5)).withColumn("j", F.when(near, j1).otherwise(j2 + 0.5))
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.avg(value).alias("mean")] if value else [])
    return cell.groupBy("i", "j").agg(*aggs).where(F.col("n") >= least)


def stacked(df: DataFrame, group: str, level: str) -> DataFrame:
    """(group, level, share, left): shares of levels within groups and where each bar begins."""
    cells = df.groupBy(group, level).agg(F.count(F.lit(1)).alias("n"))
    part = Window.partitionBy(group)
    share = F.col("n") / F.sum("n").over(part)
    out = cells.withColumn("share", share)
    return out.withColumn("left", F.coalesce(F.sum("share").over(part.orderBy(level).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select(group, level, "share", "left")


def fit_line(df: DataFrame, y: str, x: str, steps: int) -> DataFrame:
    """(step, x, y): points of the line fitted to all rows, evenly from the least x to the greatest."""
    one = df.agg(F.regr_slope(y, x).alias("_m"), F.regr_intercept(y, x).alias("_k"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    points = one.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("x", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("step") / (steps - 1))
    return points.select("step", "x", (F.col("_k") + F.col("_m") * F.col("x")).alias("y"))


def dendrogram_tail(tree, n: int) -> list[tuple[int, float]]:
    """(clusters left, height) of the last n merges of a linkage, the last first."""
    return [(k + 1, float(h)) for k, h in enumerate(tree[::-1][:n, 2])]
