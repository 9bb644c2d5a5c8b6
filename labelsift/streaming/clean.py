"""Streaming extensions: the batch expressions on unbounded input. The batch engine has no streaming of its own to match."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labelsift.functions import text
from labelsift.operators.entity import account_key


def cleaned(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """Stateless: cleaned text and counts of each message."""
    return messages.withColumns(text.features(F.col(text_col), "message"))


def first_judgements(judgements: DataFrame, name: str, created: str, at: str, late: str = "1 hour") -> DataFrame:
    """The first row of each account within the watermark; state is dropped once ``late`` has passed."""
    keyed = judgements.withColumn("account_id", account_key(name, created))
    return keyed.withWatermark(at, late).dropDuplicatesWithinWatermark(["account_id"])


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n) of tumbling windows; late rows beyond the watermark are dropped by the engine."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")
