"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's vector is the mean of the embeddings of its hashed subwords (byte n-grams inside and across the ends of
words); a linear layer and softmax give the languages' probabilities. Embeddings and layer are trained together by stochastic
gradient descent in numpy on at most SAMPLE labelled texts, each as the counts of all its subwords' buckets. After training, embedding times layer is one table of
languages by buckets, so whole texts are scored by a gather and a sum. A temperature fitted on texts left out of the
training calibrates the probabilities, and answers below the confidence that keeps the wanted precision there are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from labelsift.llm.common import bucket_of, table

#: Most labelled texts to fit on; they are those of least hash, and each language gets an equal share. Whole texts are
#: read, but only counts of buckets reach the driver: 6 bytes for each of BUCKETS at most.
SAMPLE = 4000
#: Subwords up to which a longer text moves the embeddings further in a step.
REACH = 2000
BUCKETS = 1 << 16
DIMENSION = 16
ORDERS = (2, 3, 4)
EPOCHS = 6
RATE = 0.5
SEED = 20
#: Share of the accepted answers that should be right.
PRECISION = 0.99
UNKNOWN = "und"
#: Bytes of text that are hashed together.
BLOCK = 1 << 20

_SPACED = bytes(b if b >= 128 or 97 <= b <= 122 else (b + 32 if 65 <= b <= 90 else 32) for b in range(256))


def subwords(data: bytes, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram that starts at each byte; bytes other than letters are spaces."""
    codes = np.frombuffer(data, np.uint8).astype(np.uint32)
    out, rolled = [], codes.copy()
    for n in range(1, max(orders) + 1):
        if n > 1:
            rolled = rolled[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n in orders:
            mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            out.append((mixed >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int32))
    return out


def as_bytes(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "ignore").translate(_SPACED) + b" "


def pieces(data: bytes) -> Iterator[bytes]:
    """A text in pieces of BLOCK, each with what the windows that begin in it need of the next."""
    for at in range(0, len(data), BLOCK):
        yield data[at : at + BLOCK + max(ORDERS) - 1]


def begun(lengths: np.ndarray, n: int) -> np.ndarray:
    """How many windows of n bytes begin in pieces of these lengths."""
    return np.clip(lengths - n + 1, 0, BLOCK)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's subwords, and how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    for piece in pieces(as_bytes(text)):
        for n, grams in zip(ORDERS, subwords(piece), strict=True):
            total += np.bincount(grams[: int(begun(np.array(len(piece)), n))], minlength=BUCKETS)
    held = np.flatnonzero(total)
    return held, total[held]


class Model:
    """``weights``: buckets by languages; ``bias``; ``temperature``; ``threshold`` of the rejection."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0):
        self.languages, self.weights, self.bias, self.temperature, self.threshold = languages, weights, bias, temperature, threshold

    def logits(self, texts: list[str]) -> np.ndarray:
        """Rows of logits; the mean runs over all subwords of the whole text, in blocks of bounded size."""
        out = np.zeros((len(texts), len(self.languages)), np.float64)
        block: list[bytes] = []
        owners: list[int] = []
        size = 0
        total = np.zeros(len(texts))

        def flush() -> None:
            nonlocal size
            lengths = np.array([*map(len, block)])
            starts = np.cumsum(lengths) - lengths
            # padded, so that the last piece's sum runs over as many numbers as any other's: the order of additions matters to the last bit
            for n, grams in zip(ORDERS, subwords(b"".join(block) + bytes(max(ORDERS))), strict=True):
                values, valid = self.weights[grams[: lengths.sum()]], begun(lengths, n)
                for j in range(max(ORDERS) - 1):  # windows that run into the next piece are none of this one's
                    values[(starts + valid + j)[valid + j < lengths]] = 0
                # spans of one text may lie in several blocks
                np.add.at(out, owners, np.add.reduceat(values, starts, axis=0))
                np.add.at(total, owners, valid)
            block.clear()
            owners.clear()
            size = 0

        for j, text in enumerate(texts):
            for piece in pieces(as_bytes(text)):
                block.append(piece)
                owners.append(j)
                size += len(block[-1])
                if size >= BLOCK:
                    flush()
        if block:
            flush()
        return (out / np.maximum(total, 1)[:, None] + self.bias) / self.temperature


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], seed: int = SEED, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Fit on four fifths of the texts, given as their bags; the rest calibrates the temperature and the rejection threshold."""
    languages = sorted(set(langs))
    place = {lang: k for k, lang in enumerate(languages)}
    rng = np.random.default_rng(seed)
    n = len(bags)
    left_out = np.arange(n) % 5 == 4
    target = np.array([place[x] for x in langs])
    embed = rng.uniform(-1, 1, (BUCKETS, DIMENSION)).astype(np.float32) / DIMENSION
    layer, bias = np.zeros((DIMENSION, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    shares = [(counts / max(1, counts.sum())).astype(np.float32) for _, counts in bags]
    fit = np.flatnonzero(~left_out)
    steps, done = max(1, epochs * len(fit)), 0
    for _ in range(epochs):
        for j in rng.permutation(fit):
            held, share = bags[j][0], shares[j]
            mean = share @ embed[held]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[target[j]] -= 1
            now = rate * (1 - done / steps)
            done += 1
            back = layer @ p
            layer -= now * np.outer(mean, p)
            bias -= now * 0.1 * p
            embed[held] -= (now * min(bags[j][1].sum(), REACH) ** 0.5 * share)[:, None] * back
    model = Model(languages, (embed @ layer).astype(np.float32), bias)
    if left_out.any():
        logits = np.stack([shares[j].astype(np.float64) @ model.weights[bags[j][0]] + bias for j in np.flatnonzero(left_out)])
        true = target[left_out]

        def loss(t: float) -> float:
            return -np.log(np.maximum(softmax(logits / t)[np.arange(len(true)), true], 1e-12)).mean()

        grid = np.geomspace(0.02, 20, 61)
        model.temperature = float(grid[np.argmin([loss(t) for t in grid])])
        p = softmax(logits / model.temperature)
        sure, right = p.max(1), p.argmax(1) == true
        order = np.argsort(-sure, kind="stable")
        precise = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION
        model.threshold = float(sure[order][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0
    return model


def fit(labelled: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Train on ``sample`` labelled rows at most: an equal share of each language, chosen by hash of the id. None without labels.

    Rows of a null language or text are left out; a null id is an id like others; of ties the least text comes first; repeated rows
    count as often as they occur. Other columns are ignored. One pass counts the languages, one finds the sample.
    """
    odds = F.pmod(F.xxhash64(F.col(id_col), F.lit("language sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), odds.alias("o")).where("lang IS NOT NULL AND text IS NOT NULL")
    kinds = rows.groupBy("lang").count().collect()  # one row a language
    if not kinds:
        return None
    share = max(1, sample // len(kinds))
    cuts = [(k["lang"], 1.2 * share / k["count"] + 1e-9 if k["count"] > 2 * share else 1.0) for k in kinds]
    spark = labelled.sparkSession
    few = rows.join(F.broadcast(spark.createDataFrame(cuts, "lang string, cut double")), "lang").where("o < cut")
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("o", "text"))).where(F.col("r") <= share)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [bag(t) for t in frame["text"]]
            yield pd.DataFrame({"o": frame["o"], "lang": frame["lang"], "buckets": [b.astype("<u2").tobytes() for b, _ in got], "counts": [np.minimum(c, 2**32 - 1).astype("<u4").tobytes() for _, c in got]})

    held = ranked.select("o", "lang", "text").mapInPandas(count, "o double, lang string, buckets binary, counts binary")
    got = sorted((r.o, r.lang, bytes(r.buckets), bytes(r.counts)) for r in held.toLocalIterator())
    bags = [(np.frombuffer(b, "<u2").astype(np.int64), np.frombuffer(c, "<u4").astype(np.int64)) for _, _, b, c in got]
    return train(bags, [x[1] for x in got])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, lang_pred, score (calibrated probability of lang_pred) and rejected.

    A null text, or one without a letter, is "und" with score 0 and rejected, as is every text if there is no model.
    Other texts get a learned language, and rejected tells whether its probability is under the calibrated threshold. A row's answer depends on
    its text alone, not on its neighbours. Texts may have any length; ids may be null; repeated rows each get their row; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for frame in frames:
            texts = frame["text"].tolist()
            lettered = [m is not None and t is not None and any(map(str.isalpha, t)) for t in texts]
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if any(lettered):
                p = softmax(m.logits([t for t, yes in zip(texts, lettered, strict=True) if yes]))
                where = np.flatnonzero(lettered)
                best = p.argmax(1)
                score[where] = p[np.arange(len(where)), best]
                for j, k in zip(where, best, strict=True):
                    lang[j] = m.languages[k]
            yield pd.DataFrame({"id": frame["id"], "lang_pred": lang, "score": np.clip(score, 0, 1), "rejected": (score < m.threshold) | ~np.array(lettered, bool) if m else True})

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(predict, f"id {kind}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_col)


def held_out(id_col: Column) -> Column:
    return F.coalesce(bucket_of(id_col, 4) == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
