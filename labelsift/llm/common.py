"""What several operators share: tables, word tokens, folds and shared-storage tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed value: the ASCII white space of the token contract.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Ids up to which a filter of them is broadcast; beyond, a bitmap of them is. The driver holds a broadcast table several times over, at
#: some 100 bytes an id, so this bounds its memory whatever the data.
BROADCAST_IDS = 1 << 16
#: Bits of that bitmap: 4 MB.
FILTER_BITS = 1 << 25
#: Bits of the map of indexed keys: 32 MB.
BITMAP_BITS = 1 << 28

#: Narrow rows that one task writes, where their number is known to be small.
ROWS_A_FILE = 100_000

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def bucket_of(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null has no bucket."""
    return (F.crc32(col.cast("string").cast("binary")) % F.lit(n)).cast("int")


def words(col: Column) -> Column:
    """ASCII-lower-cased words of a text; no words for null."""
    parts = F.split(ascii_lower(F.coalesce(col, F.lit(""))), SPACE)
    return F.filter(parts, lambda w: w != "")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local one if all runs in this process (tests);
    on a cluster, where executors would each write to their own disk, an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{tempfile.gettempdir()}/labelsift-shared"
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_all() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            continue


@contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Fewer rows in the batches of what is run inside, where rows are wide."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, and a lost executor loses nothing. ``rows``: a known bound of its
    rows, if they are narrow; few of them go to few files.

    The tables are removed by scratch() or discard(), or else when the driver's Python ends.
    """
    spark = df.sparkSession
    if not _written:
        atexit.register(_drop_all)
    path = f"{shared_folder(spark).rstrip('/')}/labelsift-{name}-{uuid.uuid4().hex}"
    if rows is not None and rows < ROWS_A_FILE * df.sparkSession.sparkContext.defaultParallelism:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    df.write.parquet(path)
    _written.append((spark, path))
    # without the schema, an empty table couldn't be read
    back = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    back._stored_at = path
    return back


def discard(df: DataFrame) -> None:
    """Remove a table that materialize() gave, which nothing reads any more."""
    _remove(df.sparkSession, df._stored_at)
    _written.remove(next(w for w in _written if w[1] == df._stored_at))


@contextmanager
def scratch():
    """Tables materialized inside are removed at the end, except those appended to the list that is given.

    What is kept must be materialized itself, so that nothing reads the others any more.
    """
    begun, kept = len(_written), []
    yield kept
    stay = {df._stored_at for df in kept}
    for spark, path in [w for w in _written[begun:] if w[1] not in stay]:
        _remove(spark, path)
        _written.remove((spark, path))


def known_probes(probes: DataFrame, index: DataFrame, bits: int = BITMAP_BITS, known: bool = True) -> DataFrame:
    """Probes (key, ...) without those whose key isn't in the index, as far as a bitmap of fixed size can tell; without ``known``, those that are left out so.

    The bitmap marks the index keys modulo ``bits``; it is sent to the tasks in rows of 4 KB (2 ** 15 bits), so it has bits / 8 bytes whatever
    the data. The more keys there are, the less it spares; nothing else depends on it.
    """
    place = F.pmod(F.col("key"), F.lit(bits))
    marks = index.select(place.alias("p")).groupBy(F.shiftright("p", 15).alias("_row")).agg(F.bitmap_construct_agg(F.pmod("p", F.lit(1 << 15))).alias("_m"))

    def word(i: Column) -> Column:
        number = F.conv(F.hex(F.substring("_m", i * 4 + 1, F.lit(4))), 16, 10).cast("long")
        return F.when(number >= 1 << 31, number - (1 << 32)).otherwise(number).cast("int")

    # words of 32 bits are looked up faster than bytes of a string; the first byte of a word is its highest, the first bit of a byte its lowest
    marks = marks.select("_row", F.transform(F.sequence(F.lit(0), F.lit((1 << 10) - 1)), word).alias("_marks"))
    met = probes.withColumn("_p", place).join(F.broadcast(marks), F.shiftright("_p", 15) == F.col("_row"), "inner" if known else "left")
    within_row = F.col("_p").bitwiseAND(F.lit((1 << 15) - 1)).cast("int")
    bit = within_row.bitwiseAND(F.lit(31)).bitwiseXOR(F.lit(24))
    marked = F.call_function("shiftright", F.get("_marks", F.shiftright(within_row, 5)), bit).bitwiseAND(F.lit(1))
    return met.where(marked != 0 if known else F.coalesce(marked, F.lit(0)) == 0).select(*probes.columns)


def few(ids: DataFrame) -> bool:
    """Whether a table of ids may be broadcast."""
    return ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS


def held(rows: DataFrame, column: str, ids: DataFrame, are_few: bool, nulls: bool = False) -> DataFrame:
    """Rows whose ``column`` is among ``ids`` (one column); with ``nulls``, null equals null. Few ids are broadcast. Of many, a bitmap of fixed size goes to the rows first, and
    only rows that it may know are shuffled to meet the ids themselves."""
    ids = ids.select(F.col(ids.columns[0]).alias("_id_held"))
    same = F.col(column).eqNullSafe(F.col("_id_held")) if nulls else F.col(column) == F.col("_id_held")
    if are_few:
        return rows.join(F.broadcast(ids), same, "left_semi")
    keyed = rows.select(F.struct("*").alias("row"), F.xxhash64(column).alias("key"))
    near = known_probes(keyed, ids.select(F.xxhash64("_id_held").alias("key")), FILTER_BITS).select("row.*")
    return near.join(ids, same, "left_semi")
