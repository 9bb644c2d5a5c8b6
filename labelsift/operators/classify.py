"""Text and feature classifiers on pyspark.ml, out-of-fold scoring, label-noise flags, feature elimination."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from labelsift.operators import sampling, stats

#: Function words that carry no topic; a short list of our own, so results differ from longer published lists.
STOP_WORDS = tuple("a an and are as at be but by for from had has have he her his i if in is it its me my no not of on or our she so that the their them they this to us was we were what when which who will with you your".split())
LEAST_DOCUMENTS, VOCABULARY = 3, 5000
#: Rows of a part in training, and documents that are counted at once.
PART_ROWS, COUNTED_ROWS = 32_768, 2048
FLAG_MEAN, FLAG_MOST, DISAGREEMENT = 0.2, 0.5, 0.85


def tokens(text: Column, pattern: str = r"(?U)\b\w\w+\b", stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-cased words of two characters or more, without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def grams(words: Column) -> Column:
    """Words, then pairs of neighbours."""
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def vocabulary(words: DataFrame, least: int = LEAST_DOCUMENTS, most: int = VOCABULARY) -> list:
    """Rows (term, df, cf) of (_words): terms of ``least`` documents or more, the ``most`` commonest of them, ties by name. Each batch of documents
    is counted to a row a term before anything is shuffled."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(s, COUNTED_ROWS) for s in range(0, batch.num_rows, COUNTED_ROWS)):
                row, flat = _flat(part.column(0))
                terms = flat.dictionary_encode()
                code, many = terms.indices.to_numpy(), len(terms.dictionary)
                once = np.unique(row * many + code) % many if many else code
                yield pa.RecordBatch.from_arrays([terms.dictionary, *[pa.array(np.bincount(x, minlength=many)) for x in (once, code)]], names=["term", "df", "cf"])

    per = words.select("_words").mapInArrow(counted, "term string, df long, cf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    return per.where(F.col("df") >= least).orderBy(F.desc("cf"), "term").limit(most).collect()


def _flat(words: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The row of each word, and the words."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    flat = words.flatten()
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(words)), sizes)
    return (row, flat) if known.all() else (row[known], flat.drop_null())


def _weigher(known: list, n: int) -> Callable[[pa.ListArray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of documents' words: the row, term number and weight of each known term of a row, in order."""
    terms, idf = pa.array([r.term for r in known], pa.string()), np.log((1 + n) / (1.0 + np.array([r.df for r in known], float))) + 1

    def weighed(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, flat = _flat(words)
        at = pc.index_in(flat, value_set=terms)
        own = at.is_valid().to_numpy(zero_copy_only=False)
        code, tf = np.unique(row[own] * max(1, len(terms)) + at.drop_null().to_numpy(), return_counts=True)
        row, term = np.divmod(code, max(1, len(terms)))
        w = (1 + np.log(tf)) * idf[term]
        return row, term, w / np.sqrt(np.bincount(row, w * w, len(words)))[row]

    return weighed


def repeated(df: DataFrame, key: str) -> bool:
    """Whether a key is that of several rows."""
    return bool(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").head(1))


def tfidf(df: DataFrame, key: str, words: Column, least: int = LEAST_DOCUMENTS, most: int = VOCABULARY) -> DataFrame:
    """(key, term, weight): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), each document's weights of length 1. The vocabulary is bounded; it meets each document
    where it is, so no terms of documents are shuffled. Rows of one key are one document."""
    rows = df.select(key, words.alias("_words"))
    if repeated(df, key):
        rows = rows.groupBy(key).agg(F.flatten(F.collect_list("_words")).alias("_words"))
    known, n = vocabulary(rows, least, most), df.count()
    names, weighed = pa.array([r.term for r in known], pa.string()), _weigher(known, n)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(s, COUNTED_ROWS) for s in range(0, batch.num_rows, COUNTED_ROWS)):
                row, term, w = weighed(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), names.take(pa.array(term)), pa.array(w)], names=[key, "term", "weight"])

    return rows.mapInArrow(weights, StructType([df.schema[key], StructField("term", StringType()), StructField("weight", DoubleType())]))


class Sparse(NamedTuple):
    """A row a key: _i, the places of its features, ascending, and _w, their values; and the features' names."""

    rows: DataFrame
    names: list[str]


def sparse(df: DataFrame, key: str, texts: dict[str, Column], columns: Sequence[str] = ()) -> Sparse:
    """The numbers of ``columns`` and one TF-IDF block a text, under block:term (under the term alone where the block's name is empty); features by name.
    Each row's are made where it is; rows of one key take the way by union_features."""
    if repeated(df, key):
        long = union_features(df, key, df, list(columns), texts).select(key, F.regexp_replace("feature", "^:", "").alias("term"), F.col("value").alias("weight"))
        return _grouped(long, key)
    n = df.count()
    held = [(f"{b}:" if b else "", f"_t{i}", vocabulary(df.select(w.alias("_words")))) for i, (b, w) in enumerate(texts.items())]
    names = sorted([*columns, *[b + r.term for b, _, known in held for r in known]])
    place = {x: i for i, x in enumerate(names)}
    weighers = [(np.array([place[b + r.term] for r in known], int), _weigher(known, n)) for b, _, known in held]
    own = np.array([place[c] for c in columns], int)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(s, COUNTED_ROWS) for s in range(0, batch.num_rows, COUNTED_ROWS)):
                rows, places, values = [], [], []
                for j, p in enumerate(own):
                    rows, places, values = [*rows, np.arange(len(part))], [*places, np.full(len(part), p)], [*values, part.column(1 + j).to_numpy(zero_copy_only=False)]
                for j, (to, weighed) in enumerate(weighers):
                    row, term, w = weighed(part.column(1 + len(own) + j))
                    rows, places, values = [*rows, row], [*places, to[term]], [*values, w]
                row, at, w = (np.concatenate(x) for x in (rows, places, values))
                order = np.lexsort((at, row))
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(part)))]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.ListArray.from_arrays(ends, x) for x in (pa.array(at[order], pa.int32()), pa.array(w[order], pa.float64()))]], names=[key, "_i", "_w"])

    schema = StructType([df.schema[key], StructField("_i", ArrayType(IntegerType())), StructField("_w", ArrayType(DoubleType()))])
    return Sparse(df.select(key, *[F.col(c).cast("double") for c in columns], *[w.alias(f"_t{i}") for i, w in enumerate(texts.values())]).mapInArrow(packed, schema), names)


def union_features(df: DataFrame, key: str, numbers: DataFrame, columns: list[str], texts: dict[str, Column]) -> DataFrame:
    """(key, feature, value): the numeric columns of ``numbers`` and one TF-IDF block a text, under block:term."""
    parts = [numbers.select(key, *columns).unpivot([key], columns, "feature", "value")] if columns else []
    parts += [tfidf(df, key, words).select(key, F.concat(F.lit(f"{block}:"), "term").alias("feature"), F.col("weight").alias("value")) for block, words in texts.items()]
    return reduce(DataFrame.unionAll, parts)


def _grouped(weights: DataFrame, key: str) -> Sparse:
    """Of (key, term, weight)."""
    terms = [r.term for r in weights.select("term").distinct().orderBy("term").collect()]  # bounded by the vocabulary
    place = weights.sparkSession.createDataFrame(list(zip(terms, range(len(terms)), strict=True)), "term string, i int")
    per = weights.join(F.broadcast(place), "term").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "weight"))).alias("_p"))
    return Sparse(per.select(key, F.col("_p.i").alias("_i"), F.col("_p.weight").alias("_w")), terms)


def vectors(weights: DataFrame | Sparse, key: str, rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """``rows`` with a sparse vector ``features`` and the terms in order; rows without terms get zeros."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    per, terms = weights if isinstance(weights, Sparse) else _grouped(weights, key)
    n = len(terms)
    make = F.udf(lambda i, w: SparseVector(n, i or [], w or []), VectorUDT())
    return rows.join(per, key, "left").withColumn("features", make("_i", "_w")).drop("_i", "_w"), terms


def in_parts(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows in parts of some PART_ROWS rows. A fit reads its rows in hundreds of short jobs, whose time is that of starting tasks where parts are small."""
    return df.repartition(max(1, -(-n // PART_ROWS)))


def together(fit: Callable[[int], Any], parts: Sequence[int]) -> list:
    """``fit`` of each part, side by side: the jobs of one fit are short and wait for each other."""
    with ThreadPoolExecutor(len(parts)) as pool:
        return list(pool.map(inheritable_thread_target(SparkSession.active())(fit), parts))


def balanced(df: DataFrame, label: str) -> DataFrame:
    """``df`` with _weight = n / (2 n of the row's class)."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), F.sum((F.col(label) == 1).cast("long")).alias("_p"))
    out = df.crossJoin(F.broadcast(counts))
    return out.withColumn("_weight", F.col("_n") / (2.0 * F.when(F.col(label) == 1, F.col("_p")).otherwise(F.col("_n") - F.col("_p")))).drop("_n", "_p")


def logistic(train: DataFrame, label: str, features: str = "features", c: float = 1.0, balance: bool = True, tolerance: float = 1e-8):
    """L2 logistic regression with penalty 1 / C on the sum of losses; coefficients aren't rescaled."""
    ready = balanced(train, label) if balance else train.withColumn("_weight", F.lit(1.0))
    ready = ready.cache()
    try:
        total = ready.agg(F.sum("_weight")).first()[0]
        return LogisticRegression(featuresCol=features, labelCol=label, weightCol="_weight", regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=2000, tol=tolerance).fit(ready)
    finally:
        ready.unpersist()


def probability(model, df: DataFrame, name: str) -> DataFrame:
    """``df`` with the probability of label 1."""
    drop = {"rawPrediction", "probability", "prediction"} - set(df.columns)
    return model.transform(df).withColumn(name, vector_to_array("probability")[1]).drop(*drop)


def naive_bayes(train: DataFrame, label: str, features: str = "features", alpha: float = 0.5):
    """Multinomial naive Bayes; class priors are smoothed too."""
    return NaiveBayes(featuresCol=features, labelCol=label, smoothing=alpha, modelType="multinomial").fit(train)


class CalibratedSvm:
    """Linear support vectors with a sigmoid fitted to held-out margins in each of ``folds`` folds; probabilities are averaged."""

    def __init__(self, train: DataFrame, label: str, key: str, features: str = "features", c: float = 0.1, folds: int = 3, seed: int = 42):
        self.features = features
        ready = in_parts(sampling.folds(balanced(train, label), key, folds, seed, [label]), train.count()).cache()

        def part(k: int) -> tuple:
            own = ready.where(F.col("fold") != k)
            total = own.agg(F.sum("_weight")).first()[0]
            svm = LinearSVC(featuresCol=features, labelCol=label, weightCol="_weight", regParam=1.0 / (c * total), standardization=False, maxIter=30, tol=1e-4).fit(own)
            margins = self._margin(svm, ready.where(F.col("fold") == k))
            sigmoid = LogisticRegression(featuresCol="_m", labelCol=label, regParam=0.0, standardization=False).fit(margins)
            return svm, float(sigmoid.coefficients[0]), float(sigmoid.intercept)

        self.parts = together(part, range(folds))
        ready.unpersist()

    @staticmethod
    def _margin(svm, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        out = svm.transform(df)
        return out.withColumn("_m", array_to_vector(F.array(vector_to_array("rawPrediction")[1]))).drop("rawPrediction", "prediction")

    def probability(self, df: DataFrame, name: str) -> DataFrame:
        out, names = df, []
        for k, (svm, a, b) in enumerate(self.parts):
            out = svm.transform(out).withColumn(f"_p{k}", 1 / (1 + F.exp(-(vector_to_array("rawPrediction")[1] * a + b)))).drop("rawPrediction", "prediction")
            names.append(f"_p{k}")
        return out.withColumn(name, sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)).drop(*names)


def out_of_fold(df: DataFrame, key: str, label: str, trusted: Column, models: dict[str, Callable[[DataFrame], Callable[[DataFrame, str], DataFrame]]], k: int = 5, seed: int = 42) -> DataFrame:
    """``df`` with p_<model>: each row is scored by models that saw no row of its fold; only trusted rows are learned from."""
    held = df.cache()
    rows = in_parts(sampling.folds(held, key, k, seed, [label]), held.count()).cache()
    rows.count()
    held.unpersist()

    def part(f: int) -> DataFrame:
        train, scored = rows.where((F.col("fold") != f) & trusted), rows.where(F.col("fold") == f)
        for name, make in models.items():
            scored = make(train)(scored, f"p_{name}")
        return scored

    return reduce(DataFrame.unionByName, together(part, range(k)))


def consensus_flags(scored: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Rows with p_label (mean probability of their own label) and flagged: mean at most FLAG_MEAN and every model under FLAG_MOST."""
    own = [F.when(F.col(label) == 1, F.col(c)).otherwise(1 - F.col(c)) for c in columns]
    mean = sum(own[1:], own[0]) / len(own)
    most = F.greatest(*own) if len(own) > 1 else own[0]
    return scored.withColumn("p_label", mean).withColumn("flagged", ((mean <= FLAG_MEAN) & (most < FLAG_MOST)).cast("int"))


def disagreement(scored: DataFrame, label: str, p: str) -> DataFrame:
    """Rows whose label the model gives 1 - DISAGREEMENT or less, most disagreeing first."""
    gap = F.abs(F.col(label) - F.col(p))
    return scored.withColumn("disagreement", gap).where(F.col("disagreement") >= DISAGREEMENT).orderBy(F.desc("disagreement"))


def eliminate(df: DataFrame, label: str, columns: list[str], keep: int) -> list[str]:
    """Recursive elimination: the feature of smallest absolute coefficient goes until ``keep`` are left; ties drop the later name."""
    from pyspark.ml.feature import VectorAssembler

    left = list(columns)
    while len(left) > keep:
        model = logistic(VectorAssembler(inputCols=left, outputCol="_rfe").transform(df), label, "_rfe")
        sizes = [abs(x) for x in model.coefficients.toArray()]
        left.remove(min(zip(sizes, left, strict=True), key=lambda x: (x[0], [-ord(c) for c in x[1]]))[1])
    return left


def top_terms(model, terms: list[str], n: int = 15) -> tuple[list[tuple[str, float]], list[tuple[str, float]]]:
    """The n terms of least and of greatest coefficient."""
    pairs = sorted(zip(terms, model.coefficients.toArray().tolist(), strict=True), key=lambda x: (x[1], x[0]))
    return pairs[:n], pairs[::-1][:n]


def evaluate(scored: DataFrame, label: str, p: str) -> dict[str, float]:
    """Accuracy, macro precision, recall and F1, and AUC at threshold one half."""
    guess = scored.withColumn("_g", (F.col(p) >= 0.5).cast("int"))
    return {**stats.binary_report(guess, label, "_g").first().asDict(), **stats.auc(scored, p, label).first().asDict()}
