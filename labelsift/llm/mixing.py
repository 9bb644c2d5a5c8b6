"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws the exponential key -ln(u) / quality weight, u from a hash of its id; a source's documents in
order of their keys are a weighted sample without replacement. Whole epochs of a source come first; of the
last epoch, documents are taken in this order until the budget is full, by prefix sums of their sizes.

A source of any size is cut into key ranges of about RANGE documents; sums of whole ranges give each range's
start, so no task sorts a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from labelsift.llm.common import WORD, materialize, table

WEIGHTS = (1.0, 2.0, 3.0)
MOST_EPOCHS = 3
#: Documents that a key range of a source should hold, on average.
RANGE = 2000
#: Sources up to which their table (a few numbers a row) is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000


def hashed_unit(col: Column) -> Column:
    """A number in (0, 1) from the first 48 bits of the md5 of the value as text."""
    return (F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(2.0**48)


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, n) with weight and target. One row per source only: this is the sole unpartitioned window.

    Targets share the total by weight but stop at most_epochs times the source's size; the excess goes to the others by weight
    until none is above. That is water filling: with the caps in order of cap / weight, the first source whose
    even share of the rest stays within its cap fixes the level for itself and all after it.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cap = (F.col("source_size") * F.lit(most_epochs)).cast("double")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("_cap", cap)
    by_cap = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    every = Window.partitionBy()
    before = F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_level", (F.sum("source_size").over(every).cast("double") - before) / left)
    rows = rows.withColumn("_order", F.row_number().over(by_cap))
    fits = F.when(F.col("_level") <= F.col("_cap") / F.col("weight"), F.struct("_order", "_level"))
    rows = rows.withColumn("_water", F.min(fits).over(every)["_level"])
    return rows.withColumn("target", F.least(F.col("_cap"), F.col("_water") * F.col("weight"))).drop("_cap", "_level", "_order", "_water")


def mix(docs: DataFrame, size: Column, quality: Column, id_col: str = "doc_id", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """One row per row of ``docs``: the id, size, source_size, target, taken (words, repeats counted), source and weight.

    The document at the edge of the budget gives only the words that are still missing, so a source meets its target
    to a word. A null source is a source, after all others. Null sizes count as 0 and such documents are taken
    0 words; null or non-positive quality counts as 1. Equal keys go by id; rows repeated with the same id and size give
    the same words in either order. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    good = F.when(F.coalesce(quality, F.lit(1.0)) > 0, F.coalesce(quality, F.lit(1.0))).otherwise(F.lit(1.0)).cast("double")
    u = hashed_unit(F.col(id_col))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("_id"),
            F.col(source_col).alias("source"),
            F.coalesce(size, F.lit(0)).cast("long").alias("size"),
            (-F.log(u) / good).alias("_key"),
        ),
        "sizes",
    )
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    targets = materialize(source_targets(per_source, weights, most_epochs), "targets")
    if targets.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(targets.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    else:  # AQE splits a hot source's partition of this plain join
        joined = rows.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # 1 - exp(-key) grows with the key and lies in [0, 1); ranges of it are ranges of the key
    ranged = joined.withColumn("_range", F.floor((1 - F.exp(-F.col("_key"))) * F.ceil(F.col("_n") / F.lit(RANGE))).cast("long"))
    sums = ranged.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    starts = sums.select(
        F.col("source").alias("_s"), F.col("_range").alias("_r"),
        F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy("source", "_range").orderBy("_key", F.col("_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))
    )
    budget = F.round(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("_start") - F.col("_inside")))
    return placed.select(F.col("_id").alias(id_col), "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), "source", "weight")


def word_count(col: Column) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def label_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with _quality: 2 where labelled good, 0.5 where labelled bad, else 1."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_mark"))
    return docs.join(marks, "doc_id", "left").withColumn("_quality", F.when(F.col("_mark") == 1, 2.0).when(F.col("_mark") == 0, 0.5).otherwise(1.0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("_size"))
    rated = label_quality(docs, table(spark, sf_dir, "labels"))
    return mix(rated, F.col("_size"), F.col("_quality")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH q AS (SELECT doc_id, min(quality) AS mark FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
      / (CASE WHEN q.mark = 1 THEN 2.0 WHEN q.mark = 0 THEN 0.5 ELSE 1.0 END)::DOUBLE AS k
  FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (sum(size) * 3)::DOUBLE AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE 3.0 END::DOUBLE AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl,
    row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS o
  FROM s),
t AS (
  SELECT source, source_size, least(cap, w * first(lvl) OVER (ORDER BY CASE WHEN lvl <= cap / w THEN o END NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS FIRST, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ((budget // greatest(source_size, 1)) * size
    + least(size, greatest(0, budget - (budget // greatest(source_size, 1)) * source_size - before)))::BIGINT AS taken
FROM p
"""
