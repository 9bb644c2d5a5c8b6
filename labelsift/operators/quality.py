"""Data quality: assertion rows, a data dictionary, key-set comparisons, an audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Endings of column names and what they say.
SUFFIXES = {
    "_hex": "colour code, six hexadecimal digits", "_brightness": "perceived brightness, 0 to 255", "_status": "how the colour code was repaired", "_usable": "1 if the colour code is usable",
    "_zero_suspect": "1 if the code was a bare 0", "_raw": "text as received", "_clean": "cleaned text", "_len": "characters of the cleaned text", "_word_count": "words of the cleaned text",
    "_n_urls": "links in the raw text", "_n_mentions": "mentions in the raw text", "_n_hashtags": "hashtags in the raw text", "_n_mojibake": "corrupted runs in the raw text",
    "_r": "red channel", "_g": "green channel", "_b": "blue channel",
}


def checks(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(check_name, ok): each an aggregate condition; all in one pass. Null is a failure."""
    one = df.agg(*[F.coalesce(c, F.lit(False)).alias(name) for name, c in conditions.items()])
    return one.unpivot([], list(conditions), "check_name", "ok")


def all_rows(condition: Column) -> Column:
    """Aggregate: the condition holds, and isn't null, on every row."""
    return F.coalesce(F.bool_and(F.coalesce(condition, F.lit(False))), F.lit(True))


def duplicates(*columns: str) -> Column:
    """Aggregate: rows beyond the first of each combination."""
    return F.count(F.lit(1)) - F.count_distinct(F.struct(*columns))


def dictionary(df: DataFrame, described: dict[str, str] | None = None, distinct: bool = True) -> DataFrame:
    """(column, dtype, missing, n_unique, description) from one aggregate over all columns. If descriptions are given, every column needs one."""
    known = described or {}

    def text(c: str) -> str:
        return known.get(c) or next((d for s, d in SUFFIXES.items() if c.endswith(s)), "undocumented")

    bare = [c for c in df.columns if text(c) == "undocumented"] if described is not None else []
    if bare:
        raise ValueError(f"columns without a description: {', '.join(bare)}")

    # one aggregate; with many columns, distinct counts of each expand the rows by as many
    aggs = [F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]
    aggs += [(F.count_distinct(c) if distinct else F.lit(None).cast("long")).alias(f"u{i}") for i, c in enumerate(df.columns)]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"m{i}").alias("missing"), F.col(f"u{i}").alias("n_unique"), F.lit(text(c)).alias("description")) for i, (c, t) in enumerate(df.dtypes)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def key_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(only_left, only_right): distinct keys that the other side lacks; equal sets have 0 and 0."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").agg(F.count(F.lit(1)).alias("only_left")).crossJoin(b.join(a, key, "left_anti").agg(F.count(F.lit(1)).alias("only_right")))


class Audit:
    """Metrics of a run as rows (step, metric, value), collected at the end."""

    def __init__(self):
        self.frames: list[DataFrame] = []

    def add(self, step: str, one: DataFrame) -> None:
        """``one`` has a single row; each column is a metric."""
        cells = [F.struct(F.lit(step).alias("step"), F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in one.columns]
        self.frames.append(one.select(F.explode(F.array(*cells)).alias("x")).select("x.*"))

    def frame(self) -> DataFrame | None:
        out = None
        for f in self.frames:
            out = f if out is None else out.union(f)
        return out

    def write_text(self, path: str) -> None:
        self.frame().select(F.concat_ws("\t", "step", "metric", "value")).coalesce(1).write.mode("overwrite").text(path)
