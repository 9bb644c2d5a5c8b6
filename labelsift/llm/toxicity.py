"""Toxicity after noisy-channel deobfuscation.

A token that holds leetspeak signs, a letter three times or more, or letters spelled apart is a lattice: each
position may be read as a letter, as nothing or as a gap, at a channel cost. The Viterbi path under a
character trigram model of the whole corpus restores it; a token with one path restores to itself. The restored
words (with doubled letters made one, and their beginnings) are the features of a logistic regression, fitted in numpy on at most
SAMPLE labelled documents with the SELECTED features whose presence tells most about the label.

Everything sent to the driver or the tasks is bounded: the trigram table by the alphabet, features by SELECTED,
labelled ids by SAMPLE.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelsift.llm.common import bucket_of, table

#: Most labelled documents to fit on, those of least hash.
SAMPLE = 24_000
SELECTED = 4096
#: Labelled-toxic documents that must hold a feature.
LEAST = 3
#: Tokens whose features a worker keeps; the store is emptied when full.
KEPT = 200_000
#: Symbols of the character model: a gap, a-z, the letters U+00E0 to U+00FF, any other letter.
GAP, OTHER, SYMBOLS = 0, 59, 60
#: Letters that signs may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "£": "l", "ß": "b"}
SUBSTITUTE, DROP_SIGN, KEEP_SIGN, REPEAT, JOIN, SPLIT = 0.7, 3.5, 3.0, 0.7, 0.2, 1.2

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[0xE0:0x100] = np.arange(27, 59)
_SYMBOL[[0xF7]] = 0

_APART = re.compile(r"(?<!\S)[^\W_](?:[ ._*\-]{1,2}[^\W_]){3,}(?![^\s.,;:!?])")
_ODD = re.compile(r"[^\W\d_]")
_RUN = re.compile(r"(.)\1{2,}")
_TWICE = re.compile(r"(.)\1+")
_EDGE = re.compile(r"^[^\w@$]+|[^\w$@]+$|[\W_]{2,}$|(?<=\w)\$$")
_NOISE = re.compile(r"[0-9@$!|+€£]|(.)\1\1|\w[._*\-]\w")
_WORD = re.compile(r"[^\W\d_]+")


def symbols(text: str) -> np.ndarray:
    """Symbol numbers of a lower-cased text."""
    points = np.frombuffer(text.encode("utf-32-le", "ignore"), np.uint32)
    out = _SYMBOL[np.minimum(points, 255)]
    far = points > 255
    if far.any():
        out[far] = [OTHER if chr(p).isalpha() else GAP for p in points[far].tolist()]
    return out


def count_trigrams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        for text in batch.column(0):
            s = symbols(" " + (text.as_py() or "").lower() + " ")
            s = s[np.flatnonzero((s[1:] > 0) | (s[:-1] > 0))] if len(s) > 1 else s  # gaps of any width are one
            total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3) if len(s) > 2 else 0
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["gram", "n"])


class CharModel:
    """Interpolated character trigrams; ``cost[a][b][c]`` is -ln P(c | a, b)."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        bi, uni = tri.sum(0), tri.sum((0, 1))
        p1 = (uni + 1) / (uni + 1).sum()
        p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
        p3 = (tri + 5 * p2[None]) / (tri.sum(2, keepdims=True) + 5)
        self.cost = -np.log(p3).astype(np.float32)

    def __reduce__(self):
        return _rebuild, (self.cost,)


def _rebuild(cost: np.ndarray) -> CharModel:
    model = CharModel.__new__(CharModel)
    model.cost = cost
    return model


def _symbol(letter: str) -> int:
    point = ord(letter)
    return int(_SYMBOL[point]) if point < 256 else OTHER


def positions(token: str, apart: bool = False) -> list[list[tuple[str, float]]]:
    """The lattice of a lower-cased token: for each position, what it may be read as ("" for nothing) and the cost."""
    out: list[list[tuple[str, float]]] = []
    at = 0
    while at < len(token):
        sign = token[at]
        run = 1
        while at + run < len(token) and token[at + run] == sign:
            run += 1
        at += run
        reads = LEET.get(sign)
        if sign.isalpha() and sign != "ß":
            if run < 3:
                out += [[(sign, 0.0)]] * run
            else:
                out += [[(sign, 0.0)], [(sign, REPEAT), ("", REPEAT)]]
        elif sign == "ß":
            out += [[("ß", 0.0), ("b", SUBSTITUTE + 1)]] * min(run, 2)
        elif reads:
            options = [(r, SUBSTITUTE) for r in reads] + [(" ", KEEP_SIGN)] + ([("", DROP_SIGN)] if not sign.isdigit() else [])
            out += [options] * min(run, 2)
        elif apart:
            out.append([("", JOIN), (" ", SPLIT)])
        else:
            out.append([("", SPLIT), (" ", SPLIT)])
    return out


def viterbi(model: CharModel, lattice: list[list[tuple[str, float]]]) -> str:
    """The cheapest reading; of equally cheap ones, the first in order of options."""
    cost = model.cost
    states: dict[tuple[int, int], tuple[float, tuple]] = {(GAP, GAP): (0.0, ())}
    for options in lattice:
        found: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (sofar, path) in states.items():
            for letter, channel in options:
                if not letter or (letter == " " and b == GAP):
                    key, total, now = (a, b), sofar + channel, path
                else:
                    c = _symbol(letter)
                    key, total, now = (b, c), sofar + channel + float(cost[a, b, c]), (path, letter)
                old = found.get(key)
                if old is None or total < old[0]:
                    found[key] = (total, now)
        states = found
    total, path = min(((t + (float(cost[a, b, GAP]) if b != GAP else 0.0), p) for (a, b), (t, p) in states.items()), key=lambda x: x[0])
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


def restore_token(model: CharModel, token: str) -> str:
    """A token's restored words, joined by spaces."""
    core = _EDGE.sub("", _EDGE.sub("", token))
    if not _NOISE.search(core) or not _ODD.search(core):
        return core
    return viterbi(model, positions(core))


def split_apart(text: str) -> tuple[str, list[str]]:
    """A lower-cased text without its spelled-out stretches, and these stretches."""
    found: list[str] = []

    def take(m: re.Match) -> str:
        found.append(m.group())
        return " "

    return _APART.sub(take, text), found


def restore(model: CharModel, text: str) -> str:
    """The restored text: words in order of tokens, spelled-out stretches last."""
    rest, apart = split_apart(text.lower())
    words = [restore_token(model, t) for t in rest.split()] + [viterbi(model, positions(" ".join(re.findall(r"[^\W_]|[^\w\s]", a)), True)) for a in apart]
    return " ".join(w for w in words if w)


def word_features(restored: str) -> list[str]:
    """Features of restored words: the word and its beginnings, doubled letters made one."""
    out = []
    for word in _WORD.findall(restored):
        word = _TWICE.sub(r"\1", word)
        if len(word) > 2:
            out.append(word + "$")
            out += [word[:n] for n in range(4, min(len(word), 8) + 1)]
    return out


class Reader:
    """Features of texts, with a store of tokens already seen. ``known``: numbers of the features that count, or all."""

    def __init__(self, model: CharModel, known: dict[str, int] | None = None):
        self.model, self.known, self.seen = model, known, {}

    def _of(self, token: str, apart: bool = False) -> tuple:
        words = viterbi(self.model, positions(token, True)) if apart else restore_token(self.model, token)
        names = word_features(words)
        return tuple(names) if self.known is None else tuple(self.known[x] for x in names if x in self.known)

    def features(self, text: str | None) -> set:
        found: set = set()
        if not text:
            return found
        rest, apart = split_apart(text.lower())
        seen = self.seen
        for token in set(rest.split()):
            got = seen.get(token)
            if got is None:
                if len(seen) >= KEPT:
                    seen.clear()
                got = self._of(token)
                seen[token] = got
            if got:
                found.update(got)
        for stretch in apart:
            found.update(self._of(" ".join(re.findall(r"[^\W_]|[^\w\s]", stretch)), True))
        return found


def logistic(rows: list[np.ndarray], y: np.ndarray, n: int, ridge: float = 0.1, steps: int = 250) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on sets of feature numbers, by accelerated gradient steps."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows) if rows else np.zeros(0, int)
    w, b = np.zeros(n), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    square_w, square_b = np.full(n, 1e-8), 1e-8
    for step in range(steps):
        z = np.bincount(owner, w[flat], len(rows)) + b
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gw = np.bincount(flat, error[owner], n) + ridge * w
        gb = error.sum()
        square_w += gw**2
        square_b += gb**2
        w -= 0.3 * gw / np.sqrt(square_w)
        b -= 0.3 * gb / math.sqrt(square_b)
    return w, b


def cut(rows: list[np.ndarray], y: np.ndarray, n: int, folds: int = 3) -> float:
    """The log-odds, from -2 to 0, above which out-of-fold answers "toxic" have the best F1; the highest of equals."""
    z = np.zeros(len(rows))
    fold = np.arange(len(rows)) % folds
    for k in range(folds):
        fit_on = np.flatnonzero(fold != k)
        if not 0 < y[fit_on].sum() < len(fit_on):
            return 0.0
        w, b = logistic([rows[i] for i in fit_on], y[fit_on], n)
        for i in np.flatnonzero(fold == k):
            z[i] = b + w[rows[i]].sum()
    best = (-1.0, 0.0)
    for t in np.linspace(-2, 0, 41):
        hit = z >= t
        right = float((hit & (y == 1)).sum())
        best = max(best, (2 * right / max(1.0, hit.sum() + y.sum()), t))
    return float(best[1])


class Model:
    def __init__(self, chars: CharModel, known: dict[str, int], weights: np.ndarray, bias: float):
        self.chars, self.known, self.weights, self.bias = chars, known, weights, bias

    def score(self, features: Iterable[int]) -> float:
        z = self.bias + sum(self.weights[k] for k in features)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_chars(docs: DataFrame, text_col: str = "text") -> CharModel:
    counts = np.zeros(SYMBOLS**3, np.int64)
    grams = docs.select(text_col).mapInArrow(count_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    for row in grams.collect():  # at most SYMBOLS ** 3
        counts[row.gram] = row.n
    return CharModel(counts)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, selected: int = SELECTED) -> Model:
    """Fit on documents that ``labels`` marks 0 or 1, ``sample`` ids at most, in order of a hash of the id.

    Labels of a null id or other values are left out; of contradicting labels, 1 counts. Of a document that occurs repeatedly, every row
    counts. Null and empty texts have no features. Other columns are ignored, whatever their names. Without a toxic document the model calls nothing toxic.
    """
    spark = docs.sparkSession
    chars = fit_chars(docs, text_col)
    marks = labels.select(F.col(id_col).alias("_k"), F.col(label_col).alias("_y")).where(F.col("_k").isNotNull() & F.col("_y").isin(0, 1))
    chosen = marks.groupBy("_k").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_k", F.lit("toxicity sample")), "_k").limit(sample)
    # bounded by ``sample``, hence small enough to send to every task
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    rows = own.join(F.broadcast(chosen), F.col("_id") == F.col("_k")).select("_k", F.col("_y").cast("int").alias("_y"), "_t")
    shared = spark.sparkContext.broadcast(chars)

    def tally(batches):
        reader, counts = Reader(shared.value), ({}, {})

        def flush():
            names = set(counts[0]) | set(counts[1])
            if names:
                order = list(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(order), pa.array([counts[0].get(x, 0) for x in order], pa.int64()), pa.array([counts[1].get(x, 0) for x in order], pa.int64())], ["feature", "clean", "toxic"]
                )
                counts[0].clear()
                counts[1].clear()

        for batch in batches:
            for y, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                for name in reader.features(text.as_py()):
                    counts[y][name] = counts[y].get(name, 0) + 1
                if len(counts[0]) + len(counts[1]) > 300_000:
                    yield from flush()
        yield from flush()

    totals = {r._y: r["count"] for r in rows.groupBy("_y").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n1:
        return Model(chars, {}, np.zeros(0), -30.0)
    per = rows.mapInArrow(tally, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    # signed root of a one-degree chi-square of presence against label
    gap = (F.col("t") + 0.5) / (n1 + 1.0) - (F.col("c") + 0.5) / (n0 + 1.0)
    share = (F.col("t") + F.col("c") + 1.0) / (n1 + n0 + 2.0)
    strength = gap / F.sqrt(share * (1.0 - share) * (1.0 / (n1 + 1.0) + 1.0 / (n0 + 1.0)))
    best = per.where(F.col("t") >= min(LEAST, n1)).select("feature", strength.alias("s")).where("s > 3").orderBy(F.desc("s"), "feature").limit(selected)
    known = {r.feature: k for k, r in enumerate(best.collect())}
    names = spark.sparkContext.broadcast(known)

    def project(batches):
        reader = Reader(shared.value, names.value)
        for batch in batches:
            got = [sorted(reader.features(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.list_(pa.int32()))], ["k", "y", "f"])

    kind = rows.schema["_k"].dataType.simpleString()
    sets = sorted(((r.k, r.y, r.f) for r in rows.mapInArrow(project, f"k {kind}, y int, f array<int>").collect()), key=lambda x: x[0])
    found, y = [np.array(f, int) for _, _, f in sets], np.array([y for _, y, _ in sets], float)
    weights, bias = logistic(found, y, len(known))
    return Model(chars, known, weights, bias - cut(found, y, len(known)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``, all its columns with score and predicted added.

    A null or empty text has no features and gets the bias's score. Repeated rows each get their row; an empty table gives none.
    Columns named score or predicted are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop("score", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", score double"
    at = base.columns.index(text_col)

    def read(batches):
        m = shared.value
        reader = Reader(m.chars, m.known)
        for batch in batches:
            scores = [m.score(reader.features(t.as_py())) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return base.mapInArrow(read, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(id_col: Column) -> Column:
    return F.coalesce(bucket_of(id_col, 5) == 0, F.lit(False))


def learn(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    return fit(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, learn(spark, docs, sf_dir)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
