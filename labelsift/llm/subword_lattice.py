"""Log-probability of texts by subword lattices.

The pieces of an existing vocabulary are the arcs of a lattice over the bytes of a word (with a leading
space). Every byte is a piece too, so any word has a segmentation. A unigram model over the pieces, started from the vocabulary's
own order of scores and re-estimated by EM on the training words, weights all segmentations; the forward recursion in log space sums them. A word
seen in training has one more arc, from end to end: its discounted count (absolute discounting); the
discounted mass goes to the pieces. So for a word w of c training occurrences among W

    P(w) = max(c - d, 0) / W + (d * V / W) * sum over segmentations of prod p(piece)

Within a text, words come from a Polya urn over P (each word drawn is put back twice, so what a text has used
is likelier in it), whose marginal depends on the counts alone: of a word used t times, the rising factorial
sP (sP + 1) ... (sP + t - 1), over that of s for all words. There may be several such P, one for each class of
training rows (their language, say): a text's class is not looked at but summed over, with the classes' shares as weights. A text's
probability is that of its words and its end, and sums to 1 over all sequences of words.

Plan: words are counted in Arrow batches and reduced by Spark; the model pass runs over distinct words, never over
tokens. Words of the bounded FREQUENT table are scored where the text is read; pairs of (row, rarer word) are joined
with the word table by shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelsift.llm.common import bucket_of, materialize, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Most words whose counts are sent to every task; all others are joined by shuffle.
FREQUENT = 1 << 16
EM_ROUNDS = 2
#: Weight of the corpus against what a text has used, in words.
URN = 2000.0
#: Classes that get a model of their own, the most common ones; all others share one more.
CLASSES = 7
#: Distinct words that a task holds before it hands them on.
FLUSH = 200_000
#: Bytes above which a word goes through the lattice alone.
LONG = 192
CHUNK = 8192
_LN10 = math.log(10)


def load_pieces(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a SentencePiece file in the order of their scores, without those that lower-cased words can't hold."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    found: dict[bytes, None] = {}
    for i in ids:
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if piece.lower() == piece and not piece[1:].count(b" ") and len(piece.split()) <= 1:
            found[piece] = None
    for byte in [b" ", *(bytes([b]) for b in range(256) if b not in b" \t\n\r\x0b\x0c")]:
        found.setdefault(byte, None)
    return list(found)


class Lattice:
    """Pieces as a byte trie. ``logp`` has one entry a piece and, last, the log-probability that a word stops."""

    def __init__(self, pieces: list[bytes]):
        edges: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        nodes = 1
        for k, piece in enumerate(pieces):
            at = 0
            for byte in piece:
                to = edges.get((at, byte))
                if to is None:
                    to = edges[at, byte] = nodes
                    nodes += 1
                at = to
            ends[at] = k
        self.dead = nodes
        self.next = np.full((nodes + 1, 256), nodes, np.int32)
        for (at, byte), to in edges.items():
            self.next[at, byte] = to
        self.piece = np.full(nodes + 1, -1, np.int32)
        for at, k in ends.items():
            self.piece[at] = k
        self.n = len(pieces)

    def start(self, pieces: list[bytes]) -> np.ndarray:
        """Zipf weights by the pieces' order; words stop after two pieces on average."""
        return self.fit(1.0 / (np.arange(self.n + 1) + 10.0), pieces, stop=0.5)

    @staticmethod
    def fit(weights: np.ndarray, pieces: list[bytes], stop: float | None = None) -> np.ndarray:
        """Log-probabilities: first pieces of words sum to 1, and so do other pieces and the stop."""
        first = np.array([p[:1] == b" " for p in pieces] + [False])
        later = ~first
        out = np.array(weights, float)
        if stop is not None:
            out[-1] = 0
            out[-1] = out[later].sum() * stop / (1 - stop)
        out[first] /= out[first].sum()
        out[later] /= out[later].sum()
        return np.log(out)

    def _arcs(self, grid: np.ndarray, lens: np.ndarray, i: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(end, rows, pieces) of the arcs that begin at byte i; rows are ordered by length."""
        rows = np.arange(np.searchsorted(lens, i, "right"), len(lens))
        at, end = self.next[0][grid[rows, i]], i + 1
        while rows.size:
            k = self.piece[at]
            if (hit := k >= 0).any():
                yield end, rows[hit], k[hit]
            inside = lens[rows] > end
            rows, at = rows[inside], at[inside]
            at = self.next[at, grid[rows, end]] if rows.size else at
            alive = at != self.dead
            rows, at, end = rows[alive], at[alive], end + 1

    def _chunks(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places in words, padded bytes, lengths), short words in large chunks."""
        order = np.array(sorted(range(len(words)), key=lambda j: len(words[j])), int)
        lens = np.array([len(words[j]) + 1 for j in order], int)
        at = 0
        while at < len(order):
            to = min(at + CHUNK, len(order))
            if lens[to - 1] > LONG:
                to = max(int(np.searchsorted(lens, LONG, "right")), at + 1)
                to = min(to, at + CHUNK)
            most = int(lens[to - 1])
            grid = np.frombuffer(b"".join((b" " + words[j]).ljust(most, b"\0") for j in order[at:to]), np.uint8).reshape(to - at, most)
            yield order[at:to], grid, lens[at:to]
            at = to

    def log_marginal(self, words: list[bytes], logp: np.ndarray) -> np.ndarray:
        """Natural log of the summed probability of all segmentations: words by models, of a row of ``logp`` each."""
        logp = np.atleast_2d(logp)
        out = np.zeros((len(words), len(logp)))
        arc = np.ascontiguousarray(logp.T)
        for where, grid, lens in self._chunks(words):
            forward = np.full((grid.shape[1] + 1, len(lens), len(logp)), -np.inf)
            forward[0] = 0
            for i in range(grid.shape[1]):
                for end, rows, k in self._arcs(grid, lens, i):
                    forward[end, rows] = np.logaddexp(forward[end, rows], forward[i, rows] + arc[k])
            out[where] = forward[lens, np.arange(len(lens))] + arc[-1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, and of the stop, in words that occur ``counts`` times."""
        total = np.zeros(self.n + 1)
        for where, grid, lens in self._chunks(words):
            n, most = grid.shape
            forward = np.full((n, most + 1), -np.inf)
            forward[:, 0] = 0
            arcs = []
            for i in range(most):
                for end, rows, k in self._arcs(grid, lens, i):
                    forward[rows, end] = np.logaddexp(forward[rows, end], forward[rows, i] + logp[k])
                    arcs.append((i, end, rows, k))
            whole = forward[np.arange(n), lens]
            backward = np.full((n, most + 1), -np.inf)
            backward[np.arange(n), lens] = 0
            for i, end, rows, k in reversed(arcs):
                path = backward[rows, end] + logp[k]
                backward[rows, i] = np.logaddexp(backward[rows, i], path)
                total += np.bincount(k, np.exp(forward[rows, i] + path - whole[rows]) * counts[where[rows]], self.n + 1)
            total[-1] += counts[where].sum()
        return total


_lattices: dict[int, Lattice] = {}


def _lattice(shared) -> tuple[Lattice, list[bytes], np.ndarray]:
    """The trie of a broadcast (key, pieces, logp), built once in each Python worker."""
    key, pieces, logp = shared.value
    if key not in _lattices:
        _lattices.clear()
        _lattices[key] = Lattice(pieces)
    return _lattices[key], pieces, logp


def tokens(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words; bytes methods know only ASCII letters and white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, text) to (word, class, n); class -1 is not learned from."""
    seen: dict[int, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for kind, counts in seen.items():
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(np.full(len(counts), kind, np.int32)), pa.array(list(counts.values()), pa.int64())], ["word", "class", "n"])
        seen.clear()

    for batch in batches:
        for kind, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            seen.setdefault(kind, Counter()).update(tokens(text.as_py()))
            if sum(map(len, seen.values())) > FLUSH:
                yield from flush()
    yield from flush()


def log_gamma(x, log):
    """Log of the gamma function of x >= 1, a Column or an array, with its ``log``: Stirling's series seven places up, to 13 digits."""
    y, below = x + 7.0, x
    for k in range(1, 7):
        below = below * (x + float(k))
    return (y - 0.5) * log(y) - y + (0.5 * math.log(2 * math.pi)) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - log(below)


def _rising(log_weight: Column, times: Column) -> Column:
    """Log of weight (weight + 1) ... (weight + times - 1)."""
    weight = F.exp(log_weight)
    return log_weight + F.when(times > 1, log_gamma(weight + times, F.log) - log_gamma(weight + 1.0, F.log)).otherwise(0.0)


def log_rising(weights: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Sums over rows of the logs of w (w + 1) ... (w + t - 1), for each column of weights."""
    again = times > 1
    more = weights[again]
    return np.log(weights).sum(0) + (log_gamma(more + times[again, None], np.log) - log_gamma(more + 1.0, np.log)).sum(0)


def classes_of(rows: DataFrame, most: int) -> list:
    """The commonest classes of the rows to learn from, by name where equally common."""
    return [r["class"] for r in rows.where(~F.col("held_out")).groupBy("class").count().orderBy(F.desc("count"), "class").limit(most).collect()]


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = None, vocabulary: str = VOCABULARY, rounds: int = EM_ROUNDS, frequent: int = FREQUENT, urn: float = URN) -> DataFrame:
    """One row per row of ``docs``: the id, held_out, n_tokens, n_known, train_tokens, base_score, score and lattice_score (log10 all).

    lattice_score is the marginal of the pieces alone: the sum over all segmentations under one set of piece probabilities, without whole-word
    arcs, urn and classes.

    ``held_out`` is a boolean Column; all other rows are learned from. ``class_col`` names the classes of these rows; it isn't read of
    the rows held out, and no row's score looks at its own. Null text is the empty text, of one token
    (its end). A null held_out counts as false, a null class is a class. With no training rows, base_score is that of N = V = 0 and score rests on the
    vocabulary alone. Repeated rows each get their row; other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    context = spark.sparkContext
    group = F.col(class_col).cast("string") if class_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), group.alias("class"), F.col(text_col).alias("_text"))
    names = classes_of(rows, CLASSES)
    kinds = range(len(names) + 1)
    number = F.lit(len(names))
    for k, name in enumerate(names):
        number = F.when(F.col("class").eqNullSafe(F.lit(name)), k).otherwise(number)
    number = F.when(F.col("held_out"), -1).otherwise(number).cast("int")
    counted = rows.select(number.alias("class"), "_text").mapInArrow(count_words, "word binary, class int, n long")
    counts = materialize(counted.groupBy("word").agg(F.sum("n").alias("n"), *[F.coalesce(F.sum(F.when(F.col("class") == k, F.col("n"))), F.lit(0)).alias(f"c{k}") for k in kinds]), "words")
    total = sum((F.col(f"c{k}") for k in kinds), F.lit(0))
    facts = [f(k).alias(f"{n}{k}") for k in kinds for n, f in (
        ("W", lambda k: F.coalesce(F.sum(f"c{k}"), F.lit(0))), ("V", lambda k: F.count_if(F.col(f"c{k}") > 0)), ("one", lambda k: F.count_if(F.col(f"c{k}") == 1)), ("two", lambda k: F.count_if(F.col(f"c{k}") == 2)),
    )]
    stats = counts.agg(F.count_if(total > 0).alias("V"), *facts).first()
    ends = {r.k: r["count"] for r in rows.where(~F.col("held_out")).groupBy(number.alias("k")).count().collect()}
    n_ends = sum(ends.values())
    kinds = [k for k in kinds if ends.get(k)] or [0]
    train_tokens, distinct = sum(stats[f"W{k}"] for k in kinds) + n_ends, stats.V + (n_ends > 0)
    discount = np.array([min(max(stats[f"one{k}"] / (stats[f"one{k}"] + 2 * stats[f"two{k}"]) if stats[f"one{k}"] else 0.5, 0.1), 0.9) for k in kinds])
    size = np.array([max(stats[f"W{k}"], 1) for k in kinds], float)
    spread = np.array([discount[j] * stats[f"V{k}"] / size[j] if stats[f"W{k}"] else 1.0 for j, k in enumerate(kinds)])
    # the vocabulary bounds everything that is sent here or to the tasks
    pieces = load_pieces(vocabulary)
    start = Lattice(pieces).start(pieces)
    prior, logp, pooled = np.exp(start), np.tile(start, (len(kinds), 1)), start
    own = [f"c{k}" for k in kinds]
    for _ in range(rounds):
        shared = context.broadcast((hash(vocabulary), pieces, logp))

        def expect(batches, shared=shared):
            lattice, _, now = _lattice(shared)
            uses = np.zeros((len(now), lattice.n + 1))
            for batch in batches:
                words = np.array(batch.column(0).to_pylist(), object)
                for j in range(len(now)):
                    # each distinct word once: the pieces are there for words not yet seen
                    part = words[batch.column(1 + j).to_numpy() > 0].tolist()
                    uses[j] += lattice.expected(part, np.ones(len(part)), now[j])
            j, used = np.nonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(j), pa.array(used), pa.array(uses[j, used])], ["j", "piece", "uses"])

        uses = counts.select("word", *own).mapInArrow(expect, "j long, piece long, uses double").groupBy("j", "piece").agg(F.sum("uses").alias("uses"))
        weights = np.tile(prior, (len(kinds), 1))
        for row in uses.collect():
            weights[row.j, row.piece] += row.uses
        logp = np.array([Lattice.fit(w, pieces) for w in weights])
        pooled = Lattice.fit(prior + (weights - prior).sum(0), pieces)
    shared = context.broadcast((hash(vocabulary), pieces, np.vstack([logp, pooled])))
    p_end = (n_ends + 1) / (train_tokens + 2)
    base_under = math.log10(train_tokens + distinct + 1)

    def weigh(batches):
        lattice, _, now = _lattice(shared)
        for batch in batches:
            if batch.num_rows:
                c = np.stack([batch.column(2 + j).to_numpy() for j in range(len(now) - 1)], 1)
                every = lattice.log_marginal(batch.column(0).to_pylist(), now)
                pieces_log = every[:, :-1]
                with np.errstate(divide="ignore"):
                    whole = np.log(np.maximum(c - discount, 0) / size)
                score = np.hstack([np.logaddexp(whole, pieces_log + np.log(spread)) + math.log(urn), every[:, -1:]])
                offsets = pa.array(np.arange(0, score.size + 1, score.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(c.sum(1)), pa.array(np.log10(c.sum(1) + 1.0) - base_under), pa.ListArray.from_arrays(offsets, pa.array(score.ravel()))], ["word", "n", "c", "base", "score"]
                )

    weighed = materialize(counts.select("word", "n", *own).mapInArrow(weigh, "word binary, n long, c long, base double, score array<double>"), "weights")
    # least count at which the words are few enough to be sent around
    steps = {r.b: r["count"] for r in weighed.groupBy(F.floor(F.log2("n") * 4).alias("b")).count().collect()}
    taken, least = 0, None
    for b in sorted(steps, reverse=True):
        if taken + steps[b] > frequent:
            break
        taken, least = taken + steps[b], b
    often = weighed.where(F.floor(F.log2("n") * 4) >= least).select("word", "c", "base", "score").collect() if least is not None else []
    place = {bytes(r.word): j for j, r in enumerate(often)}
    known_words = context.broadcast((place, np.array([r.c > 0 for r in often], np.int64), np.array([r.base for r in often]), np.exp(np.array([r.score for r in often]).reshape(len(often), len(kinds) + 1))))
    end_base = math.log10(n_ends + 1.0) - base_under
    log_next, log_end, log_urn = math.log1p(-p_end), math.log(p_end), math.lgamma(urn)
    end_known = int(n_ends > 0)
    out_names = ["row", "word", "tf", "id", "held_out", "n_tokens", "n_known", "base", "score"]
    id_type = rows.schema["_id"].dataType
    id_arrow = to_arrow_type(id_type)
    lists = pa.list_(pa.float64())

    def rare(part) -> pa.RecordBatch:
        row, word, tf = ([x for p in part for x in p[j]] for j in range(3))
        n = len(row)
        return pa.RecordBatch.from_arrays(
            [pa.array(row, pa.int64()), pa.array(word, pa.binary()), pa.array(tf, pa.int64()), pa.nulls(n, id_arrow), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, lists)], out_names
        )

    def split(batches):
        places, is_known, bases, weights = known_words.value
        for batch in batches:
            part: list[tuple[list, list, list]] = []
            wide = 0
            whole: list[tuple] = []
            for row, ident, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                words = tokens(text.as_py())
                uses = Counter(words)
                at = [places.get(w, -1) for w in uses]
                idx, tf = np.array(at, np.int64), np.fromiter(uses.values(), np.int64, len(uses))
                hit = idx >= 0
                rare_words = [w for w, j in zip(uses, at, strict=True) if j < 0]
                idx = idx[hit]
                ends_here = log_end + len(words) * log_next
                score = ends_here + log_urn - math.lgamma(urn + len(words)) + log_rising(weights[idx, :-1], tf[hit])
                alone = ends_here + float(tf[hit] @ np.log(weights[idx, -1]))
                whole.append((row, ident, held, len(words) + 1, end_known + int(tf[hit] @ is_known[idx]), end_base + float(tf[hit] @ bases[idx]), [*score.tolist(), alone]))
                part.append(([row] * len(rare_words), rare_words, tf[~hit].tolist()))
                wide += len(rare_words)
                if wide > FLUSH:
                    yield rare(part)
                    part, wide = [], 0
            if wide:
                yield rare(part)
            if whole:
                row, ident, held, n, known, base, score = zip(*whole, strict=True)
                none = pa.nulls(len(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row, pa.int64()), none.cast(pa.binary()), none.cast(pa.int64()), pa.array(ident, batch.schema.field(1).type), pa.array(held, pa.bool_()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, lists)], out_names
                )

    parts = materialize(
        rows.select(F.monotonically_increasing_id().alias("row"), "_id", "held_out", "_text").mapInArrow(
            split, f"row long, word binary, tf long, id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, base double, score array<double>"
        ),
        "parts",
    )
    rare_rows = (
        parts.where(F.col("word").isNotNull()).select("row", "word", "tf")
        .join(weighed.select("word", "c", F.col("base").alias("wb"), F.col("score").alias("ws")), "word")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("k"), F.sum(F.col("tf") * F.col("wb")).alias("b"), *[F.sum(_rising(F.col("ws")[j], F.col("tf"))).alias(f"s{j}") for j in range(len(kinds))], F.sum(F.col("tf") * F.col("ws")[len(kinds)]).alias("sl"))
    )
    both = parts.where(F.col("word").isNull()).drop("word", "tf").join(rare_rows, "row", "left")
    shares = [math.log(ends.get(k, 0) / n_ends) if n_ends else 0.0 for k in kinds]
    each = F.array(*[F.col("score")[j] + F.coalesce(f"s{j}", F.lit(0.0)) + shares[j] for j in range(len(kinds))])
    summed = both.withColumn("_each", each).withColumn("_most", F.array_max("_each"))
    score = F.col("_most") + F.log(F.aggregate("_each", F.lit(0.0), lambda t, x: t + F.exp(x - F.col("_most"))))
    return summed.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        (score / _LN10).alias("score"),
        ((F.col("score")[len(kinds)] + F.coalesce("sl", F.lit(0.0))) / _LN10).alias("lattice_score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, bucket_of(F.col("doc_id"), 7) == 2, class_col="lang")
