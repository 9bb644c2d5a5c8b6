"""Jaccard join on word shingles by prefixes under several global orders.

Under any one order of all shingles, two sets of Jaccard similarity t share a shingle among the first
s - ceil(t s) + 1 of each. Candidates share one under the first order and, before verification, must also share one
under the others. The orders put frequent shingles last (by a sketch of fixed size that counts all documents) and
differ in how they break ties, so that they agree by chance only rarely. Of two linked sets, the first common shingle lies even among the first
s - ceil(2 t s / (1 + t)) + 1 of the smaller one: a pair counts only where the smaller holds the key that early. Lengths and parity bitmaps
(popcount of the XOR is at most the symmetric difference) are checked in the join.

Sets, not documents, are joined: copies are one node. Only sizes, bitmaps and the first prefix are written down; the sets themselves are made again
from the documents for those nodes whose pairs the bitmaps leave open. Keys that hold the same nodes are one key. A key that holds more than GROUP nodes isn't
paired off. It is split by size first, each node going to its own range of sizes and the next, as sizes of linked sets differ little. In
what still is too large, all are compared with one hub, and keys with one hub become one group. Other hubs follow, each compared with the nodes
that no link connects to it yet, ROUNDS in all. Nodes that links connect already aren't compared; others meet the group's nodes, by sizes and 128-bit bitmaps up to MIDDLE of them and else as bitmaps of one to two bits a shingle, in numpy, BLOCK of
them at a time, and only pairs that the bitmaps leave open go on.
Groups over BLOCK are split before by pieces of the bitmap: where at most D bits differ, one of D + 1 pieces is equal. So every
link between different sets is found or implied, and what is handed on grows with the links, not with the squares of the groups.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelsift.llm.common import arrow_batches, discard, few, held, materialize, scratch, table
from labelsift.llm.graph import components, spread_lookup

#: Nodes of a key up to which they are compared pair by pair, by sizes and bitmaps first.
GROUP = 64
#: Counters of the frequency sketch; its size doesn't grow with the data.
COUNTERS = 1 << 22
SLICE = 1 << 16
ORDERS = 3
#: Nodes of a group up to which those not linked to its hub meet the others by sizes and short bitmaps.
MIDDLE = 512
#: Nodes of a group whose whole bitmaps are compared in one task.
BLOCK = 2048
#: Hubs that a large group is compared with, one after the other, before its nodes meet each other.
ROUNDS = 5
#: Bytes of text that are hashed together.
TEXT_BLOCK = 1 << 20
#: Shingles are hashes of so many bytes.
BYTES = 6

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def mix(x: np.ndarray, k: int = 0) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[k % 8]
    x = (x ^ (x >> np.uint64(29))) * _ODD[(k + 3) % 8]
    return x ^ (x >> np.uint64(32))


class WordHasher:
    """Hashes of the words of many texts at once: polynomials in an odd base modulo 2 ** 64, mixed."""

    def __init__(self):
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            base = int(_ODD[0])
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _ODD[0])]), dtype=np.uint64)
            self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(base, -1, 1 << 64)))]), dtype=np.uint64)

    def __call__(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word hashes, number of words of each text); texts begin at ``starts`` in ``data``."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
        self._grow(n)
        inside = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[starts] = True
        edge[[0, n]] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:n]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.concatenate([[np.uint64(0)], np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * self.power[:n], dtype=np.uint64)])
        hashes = mix((total[end] - total[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64) * _ODD[1])
        at = np.searchsorted(begin, np.append(starts, n))
        return hashes, np.diff(at)


def text_shingles(column: pa.Array, width: int, hasher: WordHasher):
    """Of each text in order: its shingles in order, with repeats."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    j = 0
    while j < len(column):
        to = max(j + 1, int(np.searchsorted(offsets, offsets[j] + TEXT_BLOCK, "right")) - 1)
        to = min(to, len(column))
        hashes, counts = hasher(data[offsets[j] : offsets[to]], offsets[j:to] - offsets[j])
        wide = np.zeros(0, np.uint64)
        if len(hashes) >= width:
            wide = np.full(len(hashes) - width + 1, width, np.uint64)
            for k in range(width):
                wide = mix(wide * _ODD[0] + hashes[k : len(hashes) - width + 1 + k], k)
        at = 0
        for c in counts.tolist():
            if c >= width:
                yield wide[at : at + c - width + 1] >> np.uint64(64 - 8 * BYTES)
            else:
                out = np.full(min(c, 1), c, np.uint64)
                for k in range(c):
                    out = mix(out * _ODD[0] + hashes[at + k], k)
                yield out >> np.uint64(64 - 8 * BYTES)
            at += c
        j = to


def pack(values: np.ndarray, width: int = BYTES) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes, width: int = BYTES) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(np.uint64, copy=False)


def frequency_classes(docs: DataFrame, width: int, text_col: str, counters: int = COUNTERS) -> np.ndarray:
    """For each counter of the sketch, how far (in doublings) its count of shingles is above twice the mean; 0 for most."""

    def tally(total, waiting):
        total += np.bincount((np.concatenate(waiting) % np.uint64(counters)).astype(np.int64), minlength=counters).astype(np.uint32)

    def count(batches):
        total, hasher = np.zeros(counters, np.uint32), WordHasher()
        waiting, size = [], 0
        for batch in batches:
            for s in text_shingles(batch.column(0), width, hasher):
                waiting.append(s)
                size += len(s)
                if size > 1 << 20:
                    tally(total, waiting)
                    waiting, size = [], 0
        if waiting:
            tally(total, waiting)
        for k in range(0, counters, SLICE):
            part = total[k : k + SLICE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([zlib.compress(part.tobytes(), 1)])], ["slice", "counts"])

    def add(key, parts):
        total = np.zeros(SLICE, np.int64)
        for c in parts.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(c), np.uint32)
        return pa.table({"slice": [key[0].as_py()], "counts": [zlib.compress(total.tobytes(), 1)]})

    # slice by slice: the counts of all would be some 30 MB, and as much again for each step of the formula
    slices = {row.slice: row.counts for row in docs.select(text_col).mapInArrow(count, "slice long, counts binary").groupBy("slice").applyInArrow(add, "slice long, counts binary").collect()}
    mean = sum(int(np.frombuffer(zlib.decompress(x), np.int64).sum()) for x in slices.values()) / counters
    classes = np.zeros(counters, np.uint8)
    for k in list(slices):
        counts = np.frombuffer(zlib.decompress(slices.pop(k)), np.int64)[: counters - k]
        classes[k : k + SLICE] = np.maximum(0, np.floor(np.log2(np.maximum(counts, 1) / (2 * mean + 1))))
    return classes


def prefix(values: np.ndarray, heavy: np.ndarray, order: int, length: int) -> np.ndarray:
    """The first ``length`` of a set in an order: by frequency class, then by the order's own hash."""
    rank = heavy | (mix(values, order) >> np.uint64(6))
    n = len(values)
    if length < n // 2:  # most lie beyond the cut: look only below a bound that surely leaves enough, or at all
        low = rank < np.uint64(min(1.0, (length + 4 * length**0.5 + 4) / n) * (1 << 58))
        if np.count_nonzero(low) >= length:
            values, rank = values[low], rank[low]
    return values[np.argsort(rank, kind="stable")[:length]]


def shingle_sets(docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str, classes: Broadcast, whole: bool = False, orders: int = ORDERS) -> DataFrame:
    """(id, n, node, bits_a, bits_b, wide, first): ``node`` is the set's own hash, null for an empty set; ``first`` the prefix in the first order.
    With ``whole`` (id, n, node, grams, others): the set, and the prefixes in the other orders, in 4 bytes each."""
    kind = docs.schema[id_col].dataType
    names = ["id", "n", "node", "grams", "others"] if whole else ["id", "n", "node", "bits_a", "bits_b", "wide", "first"]
    numbers = 2 if whole else 4

    def read(batches):
        of_counter, hasher = classes.value, WordHasher()
        import xxhash

        def row(s: np.ndarray) -> tuple:
            s = np.unique(s)
            if not len(s):
                return (0, None, *[None] * 2) if whole else (0, None, 0, 0, None, None)
            grams = pack(s)
            node = _signed(xxhash.xxh3_64_intdigest(grams))
            heavy = of_counter[(s % np.uint64(len(of_counter))).astype(np.int64)].astype(np.uint64) << np.uint64(58)
            cut = len(s) - least_common(len(s), num, den) + 1
            if whole:
                return len(s), node, grams, b"".join(pack(prefix(s, heavy, k + 1, cut), 4) for k in range(1, orders))
            wide = parity(s)
            bits = int.from_bytes(fold(np.frombuffer(wide, np.uint8), 16).tobytes(), "little")
            return len(s), node, _signed(bits & _WORD), _signed(bits >> 64), wide, pack(prefix(s, heavy, 1, cut))

        for batch in batches:
            out = [row(s) for s in text_shingles(batch.column(1), width, hasher)]
            if out:
                columns = [pa.array(x, pa.int64() if k < numbers else pa.binary()) for k, x in enumerate(zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    kinds = [kind.simpleString(), *["long"] * numbers, *["binary"] * 2]
    schema = ", ".join(f"{a} {b}" for a, b in zip(names, kinds, strict=True))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(read, schema)


def parity(values: np.ndarray) -> bytes:
    """A bitmap of one to two bits a shingle, 128 at least, in which each shingle flips one bit."""
    bits = max(128, 1 << max(len(values) - 1, 1).bit_length())
    return np.packbits(np.bincount((values % np.uint64(bits)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same set in ``size`` bytes."""
    while len(bitmap) > size:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def least_difference(a: bytes, b: bytes) -> int:
    """What two sets differ in at least, by their bitmaps."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(fold(np.frombuffer(a, np.uint8), size) ^ fold(np.frombuffer(b, np.uint8), size)).sum())


_WORD = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def least_common(n: int, num: int, den: int) -> int:
    """Least size of the common part of a set of n and any set similar to it."""
    return -((-num * n) // den)


def index_length(n: int, num: int, den: int) -> int:
    """How many of a set's first shingles one must be that it shares with a similar set of its size or more."""
    return n - -((-2 * num * n) // (num + den)) + 1


def prefix_rows(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(key, node, index): the shingles before the cut in the first order; ``index`` tells those that come first enough for the smaller of a pair.
    Copies of a set are one node."""

    def read(batches):
        for batch in batches:
            keys, nodes, index = [], [], []
            for node, n, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = unpack(first)
                keys.append(got.astype(np.int64))
                nodes.append(np.full(len(got), node, np.int64))
                index.append(np.arange(len(got)) < index_length(n, num, den))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, nodes, index)], ["key", "node", "index"])

    once = sets.select("node", "n", "first").groupBy("node").agg(F.first("n").alias("n"), F.first("first").alias("first"))
    return once.mapInArrow(read, "key long, node long, index boolean")


def sift(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y, hub) of (x, y, hub, nx, ny, wx, wy): pairs that sizes and bitmaps don't rule out."""

    def read(batches):
        for batch in batches:
            out = []
            for x, y, hub, nx, ny, wx, wy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # |x XOR y| of sets of similarity t is at most (1 - t) / (1 + t) of their sizes' sum
                if max(least_difference(wx, wy), abs(nx - ny)) * (den + num) <= (den - num) * (nx + ny):
                    out.append((x, y, hub))
            if out:
                x, y, hub = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(hub, pa.bool_())], ["x", "y", "hub"])

    return pairs.select("x", "y", "hub", "nx", "ny", "wx", "wy").mapInArrow(read, "x long, y long, hub boolean")


def judge(pairs: DataFrame, num: int, den: int, orders: int = ORDERS) -> DataFrame:
    """(x, y, hub) of the pairs (x, y, hub, sx, sy) that are linked.

    A pair without a hub must share a prefix shingle in every other order before its common part is counted.
    """

    def read(batches):
        for batch in batches:
            out = []
            for x, y, hub, sx, sy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cuts = [s["n"] - least_common(s["n"], num, den) + 1 for s in (sx, sy)]
                a, b = (np.frombuffer(s["others"], "<u4") for s in (sx, sy))
                if not all(set(a[k * cuts[0] : (k + 1) * cuts[0]].tolist()) & set(b[k * cuts[1] : (k + 1) * cuts[1]].tolist()) for k in range(orders - 1)):
                    continue
                a, b = unpack(sx["grams"]), unpack(sy["grams"])
                common = len(np.intersect1d(a, b, assume_unique=True))
                if den * common >= num * (len(a) + len(b) - common):
                    out.append((x, y, hub))
            if out:
                x, y, hub = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(hub, pa.bool_())], ["x", "y", "hub"])

    return pairs.select("x", "y", "hub", "sx", "sy").mapInArrow(read, "x long, y long, hub boolean")


def _nodes_of(pairs: DataFrame) -> DataFrame:
    """(node) of pairs (x, y), once each."""
    return pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()


def verify(sets: DataFrame, whole: Callable[[DataFrame], DataFrame], pairs: DataFrame, num: int, den: int, orders: int) -> DataFrame:
    """(x, y, hub) of the pairs (x, y, hub) that are linked: bitmaps first, then prefixes under the other orders, then the sets."""
    pairs = materialize(pairs.groupBy("x", "y").agg(F.bool_or("hub").alias("hub")), "pairs")
    nodes = _nodes_of(pairs)
    maps = held(sets.select("node", "n", "wide"), "node", nodes, few(nodes)).groupBy("node").agg(F.first("n").alias("n"), F.first("wide").alias("wide"))
    both = pairs.join(maps.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("wide").alias("wx")), "x").join(maps.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("wide").alias("wy")), "y")
    with arrow_batches(sets.sparkSession, 2000):
        close = materialize(sift(both, num, den), "sifted")
    discard(pairs)
    with arrow_batches(sets.sparkSession, 200):
        # already dealt by node: both joins use the one shuffle of the sets
        full = whole(_nodes_of(close)).select("node", F.struct("n", "grams", "others").alias("s"))
        both = close.join(full.select(F.col("node").alias("x"), F.col("s").alias("sx")), "x").join(full.select(F.col("node").alias("y"), F.col("s").alias("sy")), "y")
        found = materialize(judge(both, num, den, orders), "links")
    discard(close)
    return found


def _fits(x: str, y: str, num: int, den: int) -> Column:
    """Whether two sides' sizes and short bitmaps leave a link open."""
    n_x, n_y = F.col(f"n_{x}"), F.col(f"n_{y}")
    differ = F.bit_count(F.col(f"bits_a_{x}").bitwiseXOR(F.col(f"bits_a_{y}"))) + F.bit_count(F.col(f"bits_b_{x}").bitwiseXOR(F.col(f"bits_b_{y}")))
    return (den * F.least(n_x, n_y) >= num * F.greatest(n_x, n_y)) & (differ * (den + num) <= (den - num) * (n_x + n_y))


def _pairs(active: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y, hub) of keys of few nodes, by sizes and short bitmaps; if there is a column root, the two must differ in it; if there is a column
    index, the smaller must have it, or both of one size."""
    own = ["node", "n", "bits_a", "bits_b", *[c for c in ("root", "index") if c in active.columns]]
    left, right = (active.select("key", *[F.col(c).alias(f"{c}_{side}") for c in own]) for side in ("x", "y"))
    fits = (F.col("node_x") < F.col("node_y")) & _fits("x", "y", num, den)
    if "root" in active.columns:
        fits = fits & (F.col("root_x") != F.col("root_y"))
    if "index" in active.columns:
        fits = fits & (F.col("index_x") | (F.col("n_x") > F.col("n_y"))) & (F.col("index_y") | (F.col("n_y") > F.col("n_x")))
    return left.join(right, "key").where(fits).select(F.col("node_x").alias("x"), F.col("node_y").alias("y"), F.lit(False).alias("hub"))


def _with_size(rows: DataFrame) -> DataFrame:
    """Rows (key, node, degree, ...) of keys with company, with size and hub: the node of most shared keys, which has fewest shingles of its own."""
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("degree", "node"))["node"].alias("hub")).where("size > 1")
    return rows.join(counts, "key")


def _bitmap_matrix(wide: list[bytes]) -> np.ndarray:
    size = min(map(len, wide))
    return np.stack([fold(np.frombuffer(w, np.uint8), size) for w in wide])


def compare(groups: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y, hub) of (key, node, n, root, wide): pairs of a key, not connected yet as their roots differ, that sizes and bitmaps leave open."""

    def pair(key, rows):
        node, n, root = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "root"))
        bits = _bitmap_matrix(rows.column("wide").to_pylist())
        found: list[np.ndarray] = []
        step = max(1, (1 << 24) // max(1, bits.size))
        for at in range(0, len(node), step):
            part = slice(at, at + step)
            differ = np.bitwise_count(bits[part, None] ^ bits[None]).sum(-1, dtype=np.int64)
            a, b = n[part, None], n[None]
            fits = (differ * (den + num) <= (den - num) * (a + b)) & (den * np.minimum(a, b) >= num * np.maximum(a, b)) & (root[part, None] != root[None])
            i, j = np.nonzero(fits)
            i = i + at
            found.append(np.stack([node[i], node[j]], 1)[node[i] < node[j]])
        got = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return pa.table({"x": got[:, 0], "y": got[:, 1], "hub": np.zeros(len(got), bool)})

    return groups.select("key", "node", "n", "root", "wide").groupBy("key").applyInArrow(pair, "x long, y long, hub boolean")


def split_by_pieces(groups: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of large groups keyed anew by the pieces of their bitmaps; ``bits`` and ``most`` are the group's least bitmap, in bytes, and greatest set."""

    def read(batches):
        import xxhash

        for batch in batches:
            key, node, n, root, wide, size, most = (c.to_pylist() for c in batch.columns)
            out: list[tuple] = []
            for row in zip(key, node, n, root, wide, size, most, strict=True):
                bits = np.unpackbits(fold(np.frombuffer(row[4], np.uint8), row[5]), bitorder="little")
                pieces = min((den - num) * 2 * row[6] // (den + num) + 1, len(bits))
                for k, piece in enumerate(np.array_split(bits, pieces)):
                    h = xxhash.xxh3_64_intdigest(piece.tobytes(), (row[0] * 31 + k) & _WORD)
                    out.append((_signed(h), *row[1:5]))
            if out:
                key, node, n, root, wide = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in (key, node, n, root)], pa.array(wide, pa.binary())], ["key", "node", "n", "root", "wide"])

    edges = groups.groupBy("key").agg(F.min(F.octet_length("wide")).alias("bits"), F.max("n").alias("most"))
    rows = groups.join(edges, "key").select("key", "node", "n", "root", "wide", "bits", "most")
    return rows.mapInArrow(read, "key long, node long, n long, root long, wide binary").dropDuplicates(["key", "node"])


def in_blocks(groups: DataFrame, block: int) -> DataFrame:
    """Rows of groups of any size keyed anew so that any two rows of a group meet in a key of about ``block`` rows."""
    parts = F.ceil(2 * F.col("size") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    met = groups.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return met.withColumn("key", F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other"))).drop("_own", "_other", "size")


def _unconnected(rows: DataFrame) -> DataFrame:
    """(key, size) of the keys whose nodes have not all one root."""
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), (F.min("root") != F.max("root")).alias("open")).where("open").drop("open")


def links(sets: DataFrame, whole: Callable[[DataFrame], DataFrame], num: int, den: int, group: int = GROUP, middle: int = MIDDLE, block: int = BLOCK, orders: int = ORDERS, rounds: int = ROUNDS) -> DataFrame:
    """(a, b): links between different nodes that connect all nodes that similar sets connect."""
    facts = sets.select("node", "n", "bits_a", "bits_b").distinct()
    rows = prefix_rows(sets, num, den)
    # keys that hold the same nodes, as many keys of a group of copies do, are one key
    held = rows.groupBy("key").agg(F.count(F.lit(1)).alias("nodes"), F.bit_xor(F.xxhash64("node")).alias("mark"), F.bool_or("index").alias("indexed")).where("nodes > 1 AND indexed")
    active = rows.join(held, "key").groupBy(F.xxhash64("nodes", "mark").alias("key"), "node").agg(F.count(F.lit(1)).alias("times"), F.bool_or("index").alias("index"))
    shared = materialize(active, "shared")
    degree = shared.groupBy("node").agg(F.sum("times").alias("degree"))
    active = materialize(_with_size(shared.drop("times").join(degree, "node").join(facts, "node")), "keys")
    discard(shared)
    own = ["node", "n", "bits_a", "bits_b"]
    first = _pairs(active.where(F.col("size") <= group), num, den)
    # sizes n and m of linked sets have m >= t n: they lie in one range of the logarithm to base 1/t, or in neighbouring ones
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(den / num) or 1e-12) - 1e-9)
    ranged = active.where(F.col("size") > group).select(F.explode(F.array(step, step + 1)).alias("step"), "key", "degree", *own)
    ranged = materialize(_with_size(ranged.select(F.xxhash64("key", "step").alias("key"), "degree", *own)), "ranges")
    second = _pairs(ranged.where(F.col("size") <= group), num, den)
    hot = materialize(ranged.where(F.col("size") > group).select("hub", *own).distinct(), "hot")
    # the hub is its group's own member, so its facts are there
    sides = hot.select("hub", *[F.col(c).alias(f"{c}_x") for c in own]).join(facts.select(*[F.col(c).alias(f"{c}_y") for c in own]), F.col("hub") == F.col("node_y"))
    hubs = sides.where((F.col("node_x") != F.col("node_y")) & _fits("x", "y", num, den)).select(F.col("node_x").alias("x"), F.col("node_y").alias("y"), F.lit(True).alias("hub"))
    found = verify(sets, whole, first.union(second).union(hubs), num, den, orders)
    out = found.select(F.col("x").alias("a"), F.col("y").alias("b"))
    if hot.isEmpty():
        return out
    # nodes that the links so far connect need no other link between them: a few hubs more (of those with links, if any), each compared with what it isn't
    # connected to, leave little of a group of near copies
    for k in range(rounds):
        reach = components(out, "reached").select("node", F.col("component").alias("root"))
        marked = hot.join(reach, "node", "left").select(F.col("hub").alias("key"), *own, F.coalesce("root", "node").alias("root"), F.col("root").isNotNull().alias("met"))
        rest = materialize(marked.join(_unconnected(marked), "key"), "open")
        if rest.isEmpty():
            return out
        if k == rounds - 1:
            break
        side = [*own, "root"]
        chosen = rest.groupBy("key").agg(F.min_by(F.struct(*[F.col(c).alias(f"{c}_y") for c in side]), F.struct(~F.col("met"), F.xxhash64("node", F.lit(k)))).alias("y")).select("key", "y.*")
        sides = rest.select("key", *[F.col(c).alias(f"{c}_x") for c in side]).join(chosen, "key").where((F.col("root_x") != F.col("root_y")) & _fits("x", "y", num, den))
        more = verify(sets, whole, sides.select(F.least("node_x", "node_y").alias("x"), F.greatest("node_x", "node_y").alias("y"), F.lit(True).alias("hub")), num, den, orders)
        if more.isEmpty():
            break
        out = out.union(more.select(F.col("x").alias("a"), F.col("y").alias("b")))
    pairs = _pairs(rest.where(F.col("size") <= middle), num, den)
    rest = rest.where(F.col("size") > middle).select("key", "node", "n", "root", "size")
    wide = sets.select("node", "wide").join(rest.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("wide").alias("wide"))
    rest = materialize(rest.join(wide, "node"), "wide")
    pairs = pairs.union(compare(rest.where(F.col("size") <= block), num, den))
    large = rest.where(F.col("size") > block).drop("size")
    if not large.isEmpty():
        pieces = split_by_pieces(large, num, den)
        pieces = materialize(pieces.join(_unconnected(pieces), "key"), "pieces")
        pairs = pairs.union(compare(pieces.where(F.col("size") <= block), num, den)).union(compare(in_blocks(pieces.where(F.col("size") > block), block), num, den))
    more = verify(sets, whole, pairs, num, den, orders)
    return out.union(more.select(F.col("x").alias("a"), F.col("y").alias("b")))


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, middle: int = MIDDLE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: the id, n_shingles and component_id, the least id that links reach.

    Two rows are linked when den * |common shingles| >= num * |all shingles| of their sets of ``width``-word shingles (of
    all words if there are fewer); ASCII letters are lower-cased. A null, empty or blank text has no shingles and is its own component.
    A null id never is a component's least unless all its ids are null. Repeated rows are linked to each other; other columns are
    ignored; an empty table gives no rows. Ids are integers.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    classes = docs.sparkSession.sparkContext.broadcast(frequency_classes(own, width, "text"))

    with scratch() as kept:
        with arrow_batches(docs.sparkSession, 1000):
            sets = materialize(shingle_sets(own, width, num, den, "id", "text", classes), "sets")
        members = materialize(sets.select("id", "n", "node"), "members")

        def whole(nodes: DataFrame) -> DataFrame:
            """(node, n, grams, others), once each, of some nodes: made again from one document that holds each."""
            are_few = few(nodes)
            holders = held(members, "node", nodes, are_few).groupBy("node").agg(F.min("id").alias("id")).select("id").distinct()
            made = shingle_sets(held(own, "id", holders, are_few, nulls=True), width, num, den, "id", "text", classes, whole=True)
            return held(made, "node", nodes, are_few).groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "grams", "others")])

        edges = materialize(links(sets.where(F.col("node").isNotNull()), whole, num, den, group, middle, block), "edges")
        kept += [members, edges]
    nodes = members.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"))
    reach = components(edges, "reach").join(nodes.select("node", "least"), "node")
    classes = reach.groupBy("component").agg(F.min("least").alias("component_id"))
    merged = reach.join(classes, "component").select("node", "component_id")
    alone = nodes.where("size > 1").join(merged, "node", "left_anti").select("node", F.col("least").alias("component_id"))
    result = spread_lookup(members, ["node"], merged.union(alone), F.col("id"))
    return result.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 90, 100)
