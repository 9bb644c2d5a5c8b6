"""Raw and derived files: the profile CSV with a declared schema, derived tables, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Fixed value: the raw columns in file order; those not named as numbers are text.
RAW_COLUMNS = (
    "_unit_id _golden _unit_state _trusted_judgments _last_judgment_at gender gender:confidence profile_yn profile_yn:confidence created description fav_number "
    "gender_gold link_color name profile_yn_gold profileimage retweet_count sidebar_color text tweet_coord tweet_count tweet_created tweet_id tweet_location user_timezone"
).split()
_NUMBERS = {"_unit_id": T.LongType(), "_trusted_judgments": T.LongType(), "gender:confidence": T.DoubleType(), "profile_yn:confidence": T.DoubleType(), "fav_number": T.LongType(), "retweet_count": T.LongType(), "tweet_count": T.LongType()}
#: Texts that a CSV reader of the reference environment takes for missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
RAW_SCHEMA = T.StructType([T.StructField(c, _NUMBERS.get(c, T.StringType())) for c in RAW_COLUMNS])


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def find(spark: SparkSession, candidates: list[str]) -> str:
    """The first path that exists, in any file system Spark knows."""
    for path in candidates:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of these exists: {', '.join(candidates)}; pass the path of the table")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """The raw CSV (Latin-1, quoted, fields over several lines), missing-value texts as null, with _row_id in file order.

    A quoted CR LF arrives as LF. One file is one partition, as fields span lines; many files are read in parallel.
    """
    rows = spark.read.schema(RAW_SCHEMA).options(header=True, encoding="ISO-8859-1", multiLine=True, escape='"', enforceSchema=False).csv(find(spark, [path]))
    texts = {f.name: F.when(F.col(f"`{f.name}`").isin(*MISSING), None).otherwise(F.col(f"`{f.name}`")) for f in RAW_SCHEMA if isinstance(f.dataType, T.StringType)}
    return rows.withColumns(texts).withColumn("_row_id", F.monotonically_increasing_id())


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A derived table: Parquet, or CSV (UTF-8) with a declared schema."""
    if path.rstrip("/").endswith(".csv"):
        reader = spark.read.options(header=True, multiLine=True, escape='"')
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(find(spark, [path]))
    return spark.read.parquet(find(spark, [path]))


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def export_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; ``single`` gathers small tables into one file."""
    (df.coalesce(1) if single else df).write.mode("overwrite").options(header=True, escape='"', quoteAll=False).csv(path)
