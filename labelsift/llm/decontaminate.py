"""Benchmark decontamination by spaced seeds.

Masks of SPAN tokens, WEIGHT of which count, are slid over documents and benchmark items; a window's hash under a mask ignores the
other positions, so it survives substitutions there. Documents look their hashes up in the items' table; each hit fixes a diagonal,
and along the diagonals that were hit the stretch of best score (match 1, mismatch -MISMATCH) is verified token by token. A document is
contaminated by an item if a stretch matches LEAST tokens, or SHARE of all of a shorter item's.

Items so short that SHARE of them is less than LEAST may miss one or two tokens, anywhere and at the ends of a document too. They are cut into one
block more than that: one of them is there whole, and its hash is a seed as well. So no such item is missed, in documents of any length.

Where the benchmark has few tokens, the table of the items is sent to the tasks, and documents are scanned once and never shuffled. A larger benchmark is
joined by shuffle: of the documents' hashes, those travel that a bitmap of fixed size may know from the items; a hit's document, item and diagonal are
one row, however many seeds agree, and only the stretch of the document that a diagonal covers is sent to be verified.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from labelsift.llm.common import materialize, table

#: Masks over SPAN tokens, first and last position always counting.
MASKS = ("1101001011", "1011100011", "1100110101", "1110001101")
SPAN, WEIGHT = 10, 6
MISMATCH = 2
LEAST = 10
SHARE = 0.8
#: Tokens of a benchmark up to which its table is broadcast (about 100 bytes a token and mask).
BLOCK_TOKENS = 200_000
#: Bits of the map of the items' hashes, 4 MB.
MAP_BITS = 1 << 25
#: Slots of the first look; one bit tells whether any item has a hash there.
SLOTS = 1 << 20
KEPT = 400_000

#: Items under so many tokens also have block seeds.
SHORT = math.ceil(LEAST / SHARE)

_CLEAN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def normal_tokens(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII punctuation separates them."""
    return (text or "").lower().encode("utf-8", "ignore").translate(_CLEAN).split()


class TokenHasher:
    def __init__(self):
        import xxhash

        self.hash, self.seen = xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words, seen = normal_tokens(text), self.seen
        try:
            return np.array([seen[w] for w in words], np.uint64)
        except KeyError:
            if len(seen) > KEPT:
                seen.clear()
            for w in words:
                if w not in seen:
                    seen[w] = self.hash(w)
            return np.array([seen[w] for w in words], np.uint64)


def seeds(tokens: np.ndarray, mask: int) -> np.ndarray:
    """The hash of each window under a mask."""
    n = len(tokens) - SPAN + 1
    out = np.full(max(n, 0), mask + 1, np.uint64)
    if n > 0:
        for k, on in enumerate(MASKS[mask]):
            if on == "1":
                out = (out ^ tokens[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
    return out


def best_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """(start, end, matches) of the stretch of best score; the first of equals."""
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -MISMATCH))])
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score - low))
    start = int(np.flatnonzero(score[: end + 1] == low[end])[0])
    return start, end, int(same[start:end].sum())


def block_edges(n: int) -> list[tuple[int, int]]:
    """The blocks of an item of n tokens, one more than it may miss tokens."""
    parts = n - math.ceil(SHARE * n - 1e-9) + 1
    return [(n * i // parts, n * (i + 1) // parts) for i in range(parts)]


class Seeds:
    """Sorted hashes, and of each the item and place that it comes from."""

    def __init__(self, found: list[tuple[np.ndarray, int, np.ndarray]]):
        keys = np.concatenate([np.zeros(0, np.uint64), *[k for k, _, _ in found]])
        where = np.concatenate([np.zeros((0, 2), np.int64), *[np.stack([np.full(len(k), item), at], 1) for k, item, at in found]])
        order = np.argsort(keys, kind="stable")
        self.keys, self.where = keys[order], where[order]
        self.slots = np.zeros(SLOTS, bool)
        self.slots[(keys % np.uint64(SLOTS)).astype(np.int64)] = True

    def diagonals(self, hashes: np.ndarray) -> np.ndarray:
        """(item, shift) of each hit of a document's hashes, one hash a place."""
        at = np.flatnonzero(self.slots[(hashes % np.uint64(SLOTS)).astype(np.int64)])
        low, high = np.searchsorted(self.keys, hashes[at], "left"), np.searchsorted(self.keys, hashes[at], "right")
        times = high - low
        rows = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        hits = self.where[rows]
        return np.stack([hits[:, 0], np.repeat(at, times) - hits[:, 1]], 1)


class Index:
    """Seeds of a block of items: under each mask, and under each width of the blocks of short items."""

    def __init__(self, items: list[tuple[object, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.tokens = [t for _, t in items]
        masked: list[list[tuple]] = [[] for _ in MASKS]
        blocks: dict[int, list[tuple]] = {}
        for k, t in enumerate(self.tokens):
            if SPAN <= len(t):
                for m in range(len(MASKS)):
                    s = seeds(t, m)
                    masked[m].append((s, k, np.arange(len(s))))
            if 0 < len(t) < SHORT:
                for a, b in block_edges(len(t)):
                    blocks.setdefault(b - a, []).append((chain(t[a:b], b - a), k, np.array([a])))
        self.masked = [Seeds(x) for x in masked]
        self.blocks = {width: Seeds(x) for width, x in blocks.items()}

    def matches(self, tokens: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """item number: (matched tokens, first and end token in the document) of its best verified stretch."""
        hits = [s.diagonals(seeds(tokens, m)) for m, s in enumerate(self.masked)]
        hits += [s.diagonals(chain(tokens, width)) for width, s in self.blocks.items()]
        found: dict[int, tuple[int, int, int]] = {}
        for k, shift in np.unique(np.concatenate(hits), axis=0).tolist():
            verified = verify(tokens, self.tokens[k], shift)
            if verified and verified[0] > found.get(k, (0,))[0]:
                found[k] = verified
        return found


def verify(tokens: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(matched tokens, first and end token in the document) of the best stretch on a diagonal, if it contaminates."""
    low, high = max(0, shift), min(len(tokens), shift + len(item))
    if high <= low:
        return None
    start, end, matched = best_stretch(tokens[low:high] == item[low - shift : high - shift])
    return (matched, low + start, low + end) if matched >= min(LEAST, SHARE * len(item)) else None


def chain(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n tokens."""
    count = len(tokens) - n + 1
    out = np.full(max(count, 0), n, np.uint64)
    for k in range(n if count > 0 else 0):
        out = (out ^ tokens[k : k + count]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def _token_rows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, tokens): the items that have tokens, as hashes of 8 bytes each."""

    def read(batches):
        hasher = TokenHasher()
        for batch in batches:
            got = [(j, t.tobytes()) for j, x in enumerate(batch.column(1)) if len(t := hasher(x.as_py()))]
            if got:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([j for j, _ in got])), pa.array([t for _, t in got], pa.binary())], ["item", "tokens"])

    rows = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(read, f"item {benchmark.schema[id_col].dataType.simpleString()}, tokens binary")


def _scanned(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(id, item, matched, item_tokens, first_token, end_token), the items' table broadcast: they are few by check."""
    held = items.collect()
    kinds = [to_arrow_type(t) for t in (docs.schema["id"].dataType, items.schema["item"].dataType)] + [pa.int64()] * 4
    shared = docs.sparkSession.sparkContext.broadcast(Index([(r.item, np.frombuffer(r.tokens, np.uint64)) for r in held]))

    def scan(batches):
        known, hasher = shared.value, TokenHasher()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            got = [(ids[j], known.ids[k], m, len(known.tokens[k]), a, b) for j, t in enumerate(batch.column(1)) for k, (m, a, b) in known.matches(hasher(t.as_py())).items()]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got, strict=True), kinds, strict=True)], RESULT)

    return docs.mapInArrow(scan, _schema(docs, items))


RESULT = ["id", "item", "matched", "item_tokens", "first_token", "end_token"]


def _schema(docs: DataFrame, items: DataFrame) -> str:
    return f"id {docs.schema['id'].dataType.simpleString()}, item {items.schema['item'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in RESULT[2:])


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same by joins. A document is known by its id and its text's hash, an item by a number, as ids may be null or repeated."""
    numbered = materialize(items.select(F.monotonically_increasing_id().alias("k"), "item", "tokens"), "items")
    lengths = [r.n for r in numbered.select((F.octet_length("tokens") / 8).cast("int").alias("n")).where(F.col("n") < SHORT).distinct().collect()]  # under SHORT rows
    widths = sorted({b - a for n in lengths for a, b in block_edges(n)})

    def item_seeds(batches):
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = np.frombuffer(raw, np.uint64)
                found = [(seeds(t, m), np.arange(max(0, len(t) - SPAN + 1))) for m in range(len(MASKS))]
                if len(t) < SHORT:
                    found += [(chain(t[a:b], b - a), np.array([a])) for a, b in block_edges(len(t))]
                key, at = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(np.full(len(key), k)), pa.array(at), pa.array(np.full(len(key), len(t)))], ["key", "k", "at", "n"])

    keyed = materialize(numbered.select("k", "tokens").mapInArrow(item_seeds, "key long, k long, at long, n long"), "item_seeds")
    place = F.pmod(F.col("key"), F.lit(MAP_BITS))
    marks = keyed.select(place.alias("p")).groupBy(F.shiftright("p", 15).alias("row")).agg(F.bitmap_construct_agg(F.pmod("p", F.lit(1 << 15))).alias("m"))
    table_ = np.zeros((MAP_BITS >> 15, 1 << 12), np.uint8)
    for r in marks.collect():  # MAP_BITS at most
        table_[r.row] = np.frombuffer(r.m, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table_.ravel())

    def doc_seeds(batches):
        known, hasher = shared.value, TokenHasher()
        for batch in batches:
            found = [[np.zeros(0, np.int64)] * 3]
            for j, text in enumerate(batch.column(2)):
                t = hasher(text.as_py())
                for key in [seeds(t, m) for m in range(len(MASKS))] + [chain(t, w) for w in widths]:
                    bit = key.astype(np.int64) % MAP_BITS
                    at = np.flatnonzero(known[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                    found.append([np.full(len(at), j), key[at].astype(np.int64), at])
            row, key, at = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(key), pa.array(at)], ["id", "h", "key", "at"])

    kind = docs.schema["id"].dataType.simpleString()
    known = docs.select("id", F.xxhash64("text").alias("h"), "text")
    hits = known.mapInArrow(doc_seeds, f"id {kind}, h long, key long, at long").join(keyed.withColumnRenamed("at", "place"), "key")
    diagonals = hits.select("id", "h", "k", "n", (F.col("at") - F.col("place")).alias("shift")).distinct()
    per = diagonals.groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_list(F.struct("k", "n", "shift")).alias("wanted"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))

    def stretches(batches):
        hasher = TokenHasher()
        for batch in batches:
            row, out = [], []
            for j, (text, wanted) in enumerate(zip(batch.column(2), batch.column(3).to_pylist(), strict=True)):
                t = hasher(text.as_py())
                for w in wanted:
                    low = max(0, w["shift"])
                    row.append(j)
                    out.append((w["k"], w["shift"], low, t[low : max(low, w["shift"] + w["n"])].tobytes()))
            if out:
                k, shift, low, part = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(k), pa.array(shift), pa.array(low), pa.array(part, pa.binary())], ["id", "h", "k", "shift", "low", "part"])

    once = known.dropDuplicates(["id", "h"]).join(per, same).select("id", "h", "text", "wanted")
    parts = once.mapInArrow(stretches, f"id {kind}, h long, k long, shift long, low long, part binary").join(numbered.select("k", "tokens"), "k")

    def judge(batches):
        for batch in batches:
            row, out = [], []
            for j, (shift, low, part, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shift", "low", "part", "tokens")), strict=True)):
                item = np.frombuffer(raw, np.uint64)
                got = verify(np.frombuffer(part, np.uint64), item, shift - low)
                if got:
                    row.append(j)
                    out.append((got[0], len(item), got[1] + low, got[2] + low))
            if out:
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(row)) for c in ("id", "h", "k", "shift")], *[pa.array(x, pa.int64()) for x in zip(*out, strict=True)]], ["id", "h", "k", "shift", *RESULT[2:]])

    judged = parts.select("id", "h", "k", "shift", "low", "part", "tokens").mapInArrow(judge, f"id {kind}, h long, k long, shift long, " + ", ".join(f"{c} long" for c in RESULT[2:]))
    # of one item's diagonals the best counts, the first of equals
    best = judged.groupBy("id", "h", "k").agg(F.max(F.struct("matched", -F.col("shift"), *RESULT[3:])).alias("b"))
    named = best.join(numbered.select("k", "item"), "k").select(F.col("id").alias("_id"), F.col("h").alias("_h"), "item", *[F.col(f"b.{c}").alias(c) for c in RESULT[2:]])
    return known.select("id", "h").join(named, same).select(*RESULT)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(id, item, matched, item_tokens, first_token, end_token): one row per document and item that contaminates it.

    Token numbers count the document's normalised words; the stretch is the best one. Null and empty texts and items
    match nothing; ids may be null; repeated rows each get their rows; other columns are ignored; empty tables give no rows.
    A benchmark of over ``block_tokens`` tokens is joined by shuffle, with the same result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = _token_rows(benchmark, item_col, item_text)
    size = items.agg(F.sum(F.octet_length("tokens") / 8)).first()[0] or 0
    out = _scanned(rows, items) if size <= block_tokens else _joined(rows, items)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), *RESULT[2:])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
