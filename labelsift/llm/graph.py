"""Connected components and lookups that stay even under hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labelsift.llm.common import discard, materialize


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the least node reachable.

    Alternates large-star and small-star steps (Kiveris et al.) until nothing changes; each round's edges are
    written to shared storage. Self-loops and repeated edges do no harm.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before, n = materialize(now, name), None, None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(lowest, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b"))).distinct()
        # a round has no more edges than the one before
        last, now = now, materialize(small, name, n)
        discard(last)
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before, n = state, state.n
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def spread_lookup(rows: DataFrame, keys: list[str], values: DataFrame, salt, parts: int | None = None) -> DataFrame:
    """Left join of ``rows`` to ``values`` (one row per keys) that deals a hot key's rows out by a salt.

    The values of a key are first joined to the salts under which ``rows`` hold it, so at most ``parts`` rows a key travel
    in the first join, and the rows of a key meet them in ``parts`` places.
    """
    parts = parts or 64
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(parts)).cast("int"))
    held = salted.select("_salt", *keys).distinct().join(values, keys)
    return salted.join(held, ["_salt", *keys], "left").drop("_salt")
