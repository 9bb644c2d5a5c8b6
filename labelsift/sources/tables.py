"""Loading of Parquet tables and the recommended session settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings every deployment should start from; sizes stay with the cluster's own configuration.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(master: str | None = None, app: str = "labelsift", **extra: str) -> SparkSession:
    """A session with RECOMMENDED; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (RECOMMENDED | {k.replace("__", "."): v for k, v in extra.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory, by any path Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
