"""A pipeline over ``documents``: toxicity, line copies, near copies, benchmark leaks, mixture.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
``documents``; run() applies them to the table, writing each stage's result as Parquet to the shared folder and reading it again.

Documents of one id, a null one too, share a stage's decision. Null texts have no words, lines or shingles: they stay until the mixture, which takes
documents of words only. Empty tables stay empty; other columns than those of ``documents`` are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelsift.llm import decontaminate, edit_join, mixing, shingle_join, toxicity
from labelsift.llm.common import FILTER_BITS, discard, few, known_probes, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the score predicts to be toxic go. Labels of held-out documents are not learned from."""
    docs = docs.select(*COLUMNS)
    model = toxicity.learn(spark, docs, sf_dir)
    return toxicity.score(docs, model).where("predicted = 0").select(*COLUMNS)


def without_line_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines stay where they (or, from 20 characters, lines two edits off) occur first; a document of which no line is left goes."""
    docs = docs.select(*COLUMNS)
    return edit_join.without_copies(docs, edit_join.dedup_lines(docs, short=True)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """``docs`` without the ids (_k) of ``gone``. Few of them are sent to the documents; of many a bitmap is, which tells the documents that surely stay, and the others
    are shuffled to meet the ids."""
    gone, same = materialize(gone, name), F.col("doc_id").eqNullSafe(F.col("_k"))
    if few(gone):
        return docs.join(F.broadcast(gone), same, "left_anti").select(*COLUMNS)
    keyed, keys = docs.select(*COLUMNS, F.xxhash64("doc_id").alias("key")), gone.select(F.xxhash64("_k").alias("key"))
    stay = known_probes(keyed, keys, FILTER_BITS, False)
    return stay.union(known_probes(keyed, keys, FILTER_BITS).join(gone, same, "left_anti")).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 of their five-word shingles, directly or through others, the one of least id stays."""
    docs = docs.select(*COLUMNS)
    groups = shingle_join.near_duplicates(docs, 5, 80, 100)
    leads = F.bool_or(F.col("component_id").eqNullSafe(F.col("doc_id")))
    return without(docs, groups.groupBy(F.col("doc_id").alias("_k")).agg(leads.alias("leads")).where("NOT leads").select("_k"), "near_copies")


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's text go."""
    docs = docs.select(*COLUMNS)
    leaks = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, leaks.select(F.col("doc_id").alias("_k")).distinct(), "leaks")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture with what is taken of each: epochs (whole passes) and taken (words, passes counted)."""
    docs = docs.select(*COLUMNS)
    counted = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("_size"))
    shares = mixing.mix(mixing.label_quality(counted, table(spark, sf_dir, "labels")), F.col("_size"), F.col("_quality")).where("taken > 0")
    shares = shares.select(F.col("doc_id").alias("_k"), "size", "target", "taken", F.ceil(F.col("taken") / F.col("size")).cast("long").alias("epochs")).dropDuplicates(["_k"])
    return docs.join(shares, F.col("doc_id").eqNullSafe(F.col("_k"))).select(*COLUMNS, "size", "target", "taken", "epochs")


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_line_copies),
    ("ngram_jaccard", without_near_copies),
    ("decontamination", without_leaks),
    ("mixing", mixture),
]

#: Classifier, edit distances, shingle hashes and spaced seeds are beyond SQL; the tests hold each stage against brute force, and run() against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every stage reads what the one before wrote; a stage's input is removed once its output is written."""
    docs, before = table(spark, sf_dir, "documents").select(*COLUMNS), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
