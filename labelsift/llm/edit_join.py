"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

Distinct lines are cut into THRESHOLD + 1 segments. Two lines within THRESHOLD edits share a segment of the
shorter one, at a shift that the multi-match-aware bounds of Pass-Join limit: every line is indexed by (length, segment number,
segment) and probes the lengths from its own down to THRESHOLD less. Candidates are verified by the banded bit-parallel
recurrence (Hyyro): 2 * THRESHOLD + 1 rows around the diagonal are bits of one word, advanced a column by a few bit
operations.

Documents are read twice: once for the segments, whose keys are marked in a bitmap of fixed size, and once for the probes, of which only those that the
bitmap may know are written.

Lines that share a key are joined by 64 marks of their letter pairs first, of which an edit flips four at most; only pairs that these
leave open are handed on. An index key with more than GROUP lines isn't paired off: its lines are compared with one hub, lines within THRESHOLD of it
are connected already, and only the others meet the group. The links among a hub's lines are counted by each line over arrays of
the others, without a row a pair. A group over BLOCK is keyed anew by pieces of 256 marks: of 4 * THRESHOLD + 1
pieces, linked lines have one alike. What still is over BLOCK then meets in blocks of that size. All of this is exact.

Lines under SHORTEST characters, of which two edits would change much, are grouped by equality only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelsift.llm.common import few, held, known_probes, materialize, scratch, table
from labelsift.llm.graph import components, spread_lookup

THRESHOLD = 2
#: Characters that a line must have for the edit join; shorter ones are copies only if they are the same.
SHORTEST = 20
#: Short lines without a letter or digit (brackets, rules) are layout: they stay wherever they are.
CONTENT = r"[\p{L}\p{N}]"
GROUP = 24
#: Lines of a key up to which those not linked to its hub meet the others directly, by their marks.
BLOCK = 2048
#: Words of 64 marks that groups over BLOCK are split by.
MARK_WORDS = 4
#: Pieces of a line that a candidate must hold, all but THRESHOLD of them.
PIECES = 8
WHITE = " \t\r\x0b\x0c"


def normal_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no from 0, line): trimmed of white space at both ends."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    return lines.withColumn("line", F.trim("line", F.lit(WHITE)))


def _bounds(k: int, segment: int, delta: int) -> tuple[int, int]:
    """Least and greatest shift of a segment (from 1) in a line ``delta`` longer."""
    return max(-(segment - 1), delta - (k + 1 - segment)), min(segment - 1, delta + (k + 1 - segment))


def _start(n: Column, i: int, parts: int) -> Column:
    """First character (from 0) of part i of a line of n; the longer parts come last."""
    return (F.floor(n / parts) * (i - 1) + F.greatest(F.lit(0), n % parts - (parts + 1 - i))).cast("int")


def own_segments(k: int) -> list[tuple[int, int, int]]:
    """(segment from 1, length difference, shift) of a line's own segments."""
    return [(i, 0, 0) for i in range(1, k + 2)]


def probed_segments(k: int) -> list[tuple[int, int, int]]:
    """The same for what a line looks up besides: segments of lines of its length and of lines up to k shorter, at every shift that matters."""
    return [(i, delta, shift) for delta in range(k + 1) for i in range(1, k + 2) for shift in range(_bounds(k, i, delta)[0], _bounds(k, i, delta)[1] + 1) if delta or shift]


def segment_keys(lines: DataFrame, cases: list[tuple[int, int, int]], k: int = THRESHOLD, keep: tuple[str, ...] = ("node",)) -> DataFrame:
    """The columns ``keep`` of lines (node, line, ...), with the key and number of each segment in ``cases``. A line of a null ``line``
    gets one row, of a null key and segment 0.

    Substrings are cut from UTF-32, where every character has four bytes and a cut needs no scan. The cases
    are a table of literals that one small expression runs over: unrolled, it would be too long to be compiled.
    """

    def table_of(rows: list[tuple[int, int, int]]) -> Column:
        return F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(row, ("i", "delta", "shift"), strict=True)]) for row in rows])

    chosen = F.when(F.col("line").isNull(), table_of([(0, 0, 0)])).otherwise(table_of(cases)) if "line_no" in keep else table_of(cases)
    wide = lines.select(*keep, F.encode("line", "UTF-32").alias("_wide"), F.char_length("line").alias("_n"), F.explode(chosen).alias("p"))
    wide = wide.select(*keep, "_wide", "_n", "p.*")
    n = F.col("_n") - F.col("delta")
    short, long = F.floor(n / (k + 1)).cast("int"), n % (k + 1)
    # the last ``long`` segments have one character more
    extra = F.col("i") - (k + 2 - long)
    cut = wide.withColumn("_at", short * (F.col("i") - 1) + F.greatest(F.lit(0), extra) + F.col("shift")).withColumn("_length", short + F.when(extra >= 0, 1).otherwise(0)).withColumn("_m", n)
    key = F.when(F.col("i") > 0, F.xxhash64("_m", "i", F.substring("_wide", F.col("_at") * 4 + 1, F.col("_length") * 4)))
    return cut.where("i = 0 OR (_at >= 0 AND _at + _length <= _n)").select(*keep, key.alias("key"), F.col("i").alias("segment"))


def pair_marks(line: Column, words: int = 1) -> Column:
    """An array of ``words`` times 64 bits, each flipped by the pairs of neighbouring letters that hash to it: an edit flips four at most."""
    codes = F.transform(F.split(line, ""), lambda c: F.ascii(c))

    def word(a: Column, w: int) -> Column:
        def flip(s: Column, i: Column) -> Column:
            place = F.pmod(F.get(a, i) * 31 + F.get(a, i + 1), F.lit(64 * words))
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)))
            return s.bitwiseXOR(bit if words == 1 else F.when(F.floor(place / 64) == w, bit).otherwise(F.lit(0).cast("long")))

        return F.aggregate(F.sequence(F.lit(0), F.size(a) - 2), F.lit(0).cast("long"), flip)

    return F.element_at(F.transform(F.array(codes), lambda a: F.array(*[word(a, w) for w in range(words)])), 1)


def split_by_pieces(groups: DataFrame, text: DataFrame, k: int = THRESHOLD, words: int = MARK_WORDS) -> DataFrame:
    """Rows (key, node, ...) keyed anew by each of 4 k + 1 pieces of their lines' marks. k edits flip 4 k marks at most, so lines
    that they part have a piece alike."""
    marks = text.join(groups.select("node").distinct(), "node", "left_semi").select("node", pair_marks(F.col("line"), words).alias("_w"))
    bits = F.concat(*[F.lpad(F.bin(F.get("_w", F.lit(w))), 64, "0") for w in range(words)])
    pieces = 4 * k + 1
    edges = [64 * words * i // pieces for i in range(pieces + 1)]
    cut = marks.select("node", bits.alias("_b")).select("node", F.posexplode(F.array(*[F.substring("_b", a + 1, b - a) for a, b in zip(edges, edges[1:])])).alias("_i", "_piece"))
    rest = [c for c in groups.columns if c not in ("key", "size")]
    return groups.join(cut, "node").select(F.xxhash64("key", "_i", "_piece").alias("key"), *rest)


def in_blocks(groups: DataFrame, block: int) -> DataFrame:
    """Rows (key, node, size, ...) keyed anew so that any two rows of a key meet in a key of about ``block`` rows."""
    parts = F.ceil(2 * F.col("size") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    met = groups.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return met.withColumn("key", F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other"))).drop("_own", "_other")


def holds_pieces(a: Column, b: Column, k: int = THRESHOLD, pieces: int = PIECES) -> Column:
    """Whether b holds all but k of a's pieces, each at most k characters from its place; so it does if k edits part them."""
    n = F.char_length(a)
    found = F.lit(0)
    for i in range(1, pieces + 1):
        at = _start(n, i, pieces)
        length = (_start(n, i + 1, pieces) if i < pieces else n) - at
        near = F.substring(b, F.greatest(at - k, F.lit(0)) + 1, length + k + F.least(at, F.lit(k)))
        found = found + F.contains(near, F.substring(a, at + 1, length)).cast("int")
    return found >= pieces - k


def common_prefix(a: Column, b: Column, steps: int = 24) -> Column:
    """Characters that two strings begin with alike, by bisection; a lower bound for strings of over 2 ** steps."""
    span = F.struct(F.lit(0).alias("low"), (F.least(F.char_length(a), F.char_length(b)) + 1).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = ((s["low"] + s["high"]) / 2).cast("int")
        same = F.substring(a, F.lit(1), middle) == F.substring(b, F.lit(1), middle)
        return F.when(s["high"] - s["low"] <= 1, s).otherwise(F.struct(F.when(same, middle).otherwise(s["low"]).alias("low"), F.when(same, s["high"]).otherwise(middle).alias("high")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), span, halve, lambda s: s["low"])


def within(a: Column, b: Column, k: int = THRESHOLD) -> Column:
    """Whether two strings are at most k edits apart. A common beginning, but for k characters, is left out."""
    both = F.struct(a.alias("a"), b.alias("b"), F.greatest(common_prefix(a, b) - k, F.lit(0)).alias("p"))

    def measured(x: Column) -> Column:
        cut = [F.substring(x[c], x["p"] + 1, F.char_length(x[c])) for c in ("a", "b")]
        return F.element_at(F.transform(F.array(F.struct(cut[0].alias("a"), cut[1].alias("b"))), lambda y: banded_distance(y["a"], y["b"], k)), 1)

    return F.coalesce(F.element_at(F.transform(F.array(both), measured), 1) <= k, F.lit(False))


def banded_distance(a: Column, b: Column, k: int = THRESHOLD) -> Column:
    """Edit distance of two strings if it is at most k, else a number above k or null; both need k characters or more.

    At column j, bit r of the words stands for row j - k + r. The distance is followed down the band's lower edge until it meets the
    last row, then along this row. Down the edge it never falls, and along the row by n - m + k at most: once it is too high for that,
    the columns that are left are passed over.
    """
    text = F.struct(F.split(a, "").alias("rows"), F.split(b, "").alias("columns"), F.char_length(a).alias("m"), F.char_length(b).alias("n"))
    return F.element_at(F.transform(F.array(text), lambda t: _swept(t["rows"], t["columns"], t["m"], t["n"], k)), 1)


def _swept(rows: Column, columns: Column, m: Column, n: Column, k: int) -> Column:
    full, top = (1 << (2 * k + 1)) - 1, 1 << (2 * k)

    def step(state: Column, j: Column) -> Column:
        letter = F.get(columns, j - 1)
        # nested lets keep each word evaluated once
        def with_match(match: Column) -> Column:
            vp, vn = state["vp"], state["vn"]
            d0 = ((match.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(match).bitwiseOR(vn).bitwiseAND(F.lit(full))
            return F.element_at(F.transform(F.array(d0), lambda d: with_diagonal(d)), 1)

        def with_diagonal(d: Column) -> Column:
            vp, vn = state["vp"], state["vn"]
            hp = vn.bitwiseOR(d.bitwiseOR(vp).bitwiseXOR(F.lit(full)))
            return F.element_at(F.transform(F.array(hp), lambda h: advanced(d, h)), 1)

        def advanced(d: Column, hp: Column) -> Column:
            hn = d.bitwiseAND(state["vp"])
            below = F.shiftright(d, 1)
            bit = m - j + k
            along = F.when(F.call_function("shiftright", hp, bit).bitwiseAND(F.lit(1)) == 1, 1).when(F.call_function("shiftright", hn, bit).bitwiseAND(F.lit(1)) == 1, -1).otherwise(0)
            down = F.when(d.bitwiseAND(F.lit(top)) == 0, 1).otherwise(0)
            return F.struct(
                hn.bitwiseOR(below.bitwiseOR(hp).bitwiseXOR(F.lit(full))).bitwiseAND(F.lit(full)).alias("vp"),
                below.bitwiseAND(hp).alias("vn"),
                (state["d"] + F.when(j <= m - k, down).otherwise(along)).cast("int").alias("d"),
            )

        match = F.lit(0)
        for r in range(2 * k + 1):
            match = match.bitwiseOR(F.when(F.get(rows, j - k + r - 1) == letter, 1 << r).otherwise(0))
        return F.element_at(F.transform(F.array(match), lambda x: with_match(x)), 1)

    start = F.struct(F.lit(((1 << (k + 1)) - 1) << k).alias("vp"), F.lit(0).alias("vn"), F.lit(k).alias("d"))
    swept = F.aggregate(F.sequence(F.lit(1), n), start, lambda s, j: F.when((s["d"] > 2 * k + n - m) & (j <= m - k), s).otherwise(step(s, j)), lambda s: s["d"])
    return F.when(F.abs(m - n) <= k, swept)


def _lines_of(lines: Callable[..., DataFrame], index: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, line), once each, of some nodes: read again from one document that holds each."""
    are_few = few(nodes)
    holders = held(index.where("segment = 1"), "node", nodes, are_few).groupBy("node").agg(F.min("id").alias("id")).select(F.col("id").alias("_h")).distinct()
    return held(lines(holders, are_few), "node", nodes, are_few).groupBy("node").agg(F.first("line").alias("line"))


def _sized(rows: DataFrame) -> DataFrame:
    """Rows (key, node, probe, must), once each, of keys in which two lines may be compared, with the key's size and its hub, an indexed line."""
    once = rows.groupBy("key", "node").agg(F.bool_and("probe").alias("probe"), F.bool_or("must").alias("must"))
    sizes = once.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.when(~F.col("probe"), F.col("node"))).alias("hub"), F.bool_or("must").alias("any"))
    return once.join(sizes.where("size > 1 AND hub IS NOT NULL AND any").drop("any"), "key")


def _open_pairs(groups: DataFrame, text: DataFrame, k: int) -> DataFrame:
    """(a, b), a < b: lines of a key, one of them indexed and one not linked yet, that their marks leave open."""
    marked = groups.select("key", "node", "probe", "must").join(text.select("node", "marks"), "node")
    left = marked.where("NOT probe").select("key", *[F.col(c).alias(f"{c}_x") for c in ("node", "marks", "must")])
    right = marked.select("key", *[F.col(c).alias(f"{c}_y") for c in ("node", "marks", "must")])
    open_ = (F.col("node_x") != F.col("node_y")) & (F.col("must_x") | F.col("must_y")) & (F.bit_count(F.col("marks_x").bitwiseXOR(F.col("marks_y"))) <= 4 * k)
    return left.join(right, "key").where(open_).select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))


def _linked(pairs: DataFrame, text: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) of lines within k edits."""
    both = pairs.join(text.select(F.col("node").alias("a"), F.col("line").alias("line_a")), "a").join(text.select(F.col("node").alias("b"), F.col("line").alias("line_b")), "b")
    return both.where(holds_pieces(F.col("line_a"), F.col("line_b"), k)).where(within(F.col("line_a"), F.col("line_b"), k)).select("a", "b")


def _passed_over(stars: DataFrame, edges: DataFrame, text: DataFrame, k: int, block: int) -> DataFrame:
    """(node, links): how many lines within k edits a node of ``stars`` (hub, node) has that are linked to a hub of its own and not in ``edges``.

    A star's lines are gathered in arrays of about ``block``, which each of them runs over: rows grow with the lines, not with their pairs. A
    pair of several stars counts in that of their least hub.
    """
    sides = edges.select("a", "b").union(edges.select("b", "a")).join(stars.select("node").distinct(), F.col("a") == F.col("node"), "left_semi")
    counted = sides.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("counted"))
    hubs = stars.groupBy("node").agg(F.collect_list("hub").alias("hubs"))
    facts = hubs.join(text.select("node", "line", "marks"), "node")
    sizes = stars.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("parts"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    rows = stars.join(sizes, "hub").join(facts, "node")
    parts = rows.groupBy("hub", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("node", "hubs", "line", "marks")).alias("others"))
    met = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(parts, ["hub", "part"]).join(counted, "node")

    def linked(o: Column) -> Column:
        near = (o["node"] != F.col("node")) & (F.bit_count(o["marks"].bitwiseXOR(F.col("marks"))) <= 4 * k)
        here = F.array_min(F.array_intersect(o["hubs"], F.col("hubs"))) == F.col("hub")
        return near & here & holds_pieces(F.col("line"), o["line"], k) & within(F.col("line"), o["line"], k) & ~F.array_contains("counted", o["node"])

    return met.select("node", F.size(F.filter("others", linked)).alias("n")).groupBy("node").agg(F.sum("n").alias("links")).where("links > 0")


def line_links(lines: Callable[..., DataFrame], index: DataFrame, probes: DataFrame, k: int = THRESHOLD, group: int = GROUP, block: int = BLOCK) -> tuple[DataFrame, DataFrame | None]:
    """(a, b), a < b: links of nodes that connect all lines that lines within k edits connect; and (node, links): how many links a node has
    besides, between lines that a hub connects already. Repeated lines do no harm.

    ``index`` has (node, key, segment, id) of the lines' own segments, ``probes`` (node, key) of what they look up; ``lines`` gives (node,
    line) of the documents whose ids it is given, and whether these are few.
    """
    rows = index.where("segment > 0").select("node", "key", F.lit(False).alias("probe")).union(probes.select("node", "key", F.lit(True))).withColumn("must", F.lit(True))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bool_and("probe").alias("unknown")).where("n > 1 AND NOT unknown").select("key")
    active = materialize(_sized(rows.join(shared, "key")), "keys")
    text = _lines_of(lines, index, active.select("node").distinct())
    text = materialize(text.withColumn("marks", pair_marks(F.col("line"))[0]), "texts")
    hot = active.where(F.col("size") > group)
    pairs = _open_pairs(active.where(F.col("size") <= group), text, k)
    if hot.isEmpty():
        return materialize(_linked(pairs.distinct(), text, k), "edges"), None
    spokes = hot.where(F.col("node") != F.col("hub")).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    near = materialize(_linked(spokes, text, k), "hubs")
    done = near.select(F.col("a").alias("node"), F.col("b").alias("hub")).union(near.select("b", "a")).withColumn("done", F.lit(True))
    judged = hot.join(done, ["node", "hub"], "left").withColumn("must", F.col("must") & F.col("done").isNull() & (F.col("node") != F.col("hub"))).drop("done")
    pairs = pairs.union(_open_pairs(judged.where(F.col("size") <= block), text, k))
    large = judged.where(F.col("size") > block).drop("hub")
    if not large.isEmpty():
        pieces = materialize(_sized(split_by_pieces(large, text, k)), "pieces")
        pairs = pairs.union(_open_pairs(pieces.where(F.col("size") <= block), text, k))
        pairs = pairs.union(_open_pairs(in_blocks(pieces.where(F.col("size") > block).drop("hub"), block), text, k))
    edges = materialize(near.union(_linked(pairs.distinct(), text, k)).distinct(), "edges")
    stars = hot.where(F.col("node") != F.col("hub")).select("node", "hub").distinct().join(done, ["node", "hub"], "left_semi")
    return edges, materialize(_passed_over(stars, edges, text, k, block), "passed_over")


def dedup_lines(docs: DataFrame, k: int = THRESHOLD, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, block: int = BLOCK, short: bool = False) -> DataFrame:
    """One row per line of ``shortest`` characters or more, with ``short`` per line that isn't blank: the id, line_no, first_id and first_line (the first occurrence of its
    class, by id and number), class_size (occurrences), links (all different lines within k edits) and kept.

    A class is what links within k edits connect; its first occurrence is kept. Lines under ``shortest`` form a class with equal lines only,
    and those without a letter or digit are kept everywhere. Lines are split at line feeds and trimmed. Null
    texts have no lines; rows repeated with one id share their lines' decisions, and a null id comes first. Lines of any
    length are compared whole. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    if shortest <= 2 * k or shortest < PIECES:
        raise ValueError("lines must have more than twice as many characters as edits are allowed, and one a piece")

    def lines(holders: DataFrame | None = None, are_few: bool = False) -> DataFrame:
        own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        part = own if holders is None else held(own, "id", holders, are_few, nulls=True)
        return normal_lines(part, "id", "text").where((F.col("line") != "") if short and holders is None else (F.char_length("line") >= shortest)).withColumn("node", F.xxhash64("line"))

    with scratch() as kept:
        is_short = F.char_length("line") < shortest
        every = lines().select("id", "line_no", "node", (is_short & ~F.col("line").rlike(CONTENT)).alias("stays"), F.when(~is_short, F.col("line")).alias("line"))
        cut = segment_keys(every, own_segments(k), k, ("id", "line_no", "node", "stays"))
        first = F.col("segment") <= 1
        index = materialize(cut.select(*[F.when(first, F.col(c)).alias(c) for c in ("id", "line_no")], "node", (first & F.col("stays")).alias("stays"), "key", "segment"), "lines")
        probes = known_probes(segment_keys(every.where("line IS NOT NULL"), probed_segments(k), k), index.where("key IS NOT NULL"))
        edges, besides = line_links(lines, index, materialize(probes.select("node", "key"), "probes"), k, group, block)
        kept += [index, edges, *([] if besides is None else [besides])]
    occurrences = index.where("segment <= 1").select("id", "line_no", "node", "stays")
    nodes = occurrences.groupBy("node").agg(F.min(F.struct("id", "line_no")).alias("first"), F.count(F.lit(1)).alias("size"))
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    if besides is not None:
        degree = degree.union(besides).groupBy("node").agg(F.sum("links").alias("links"))
    reach = components(edges, "classes").join(nodes, "node")
    classes = reach.groupBy("component").agg(F.min("first").alias("first"), F.sum("size").alias("size"))
    joined = reach.select("node", "component").join(classes, "component").join(degree, "node", "left").select("node", "first", "size", "links")
    repeated = nodes.where("size > 1").join(joined, "node", "left_anti")
    verdicts = joined.union(repeated.select("node", "first", "size", F.lit(0).cast("long")))
    result = spread_lookup(occurrences, ["node"], verdicts, F.struct("id", "line_no"))
    own = F.struct("id", "line_no")
    found = F.coalesce("first", own)
    return result.select(
        F.col("id").alias(id_col),
        F.col("line_no").cast("long").alias("line_no"),
        found["id"].alias("first_id"),
        found["line_no"].cast("long").alias("first_line"),
        F.coalesce("size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        (F.col("stays") | (found["id"].eqNullSafe(F.col("id")) & (found["line_no"] == F.col("line_no")))).alias("kept"),
    )


def without_copies(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the texts' dropped lines removed. Texts that lose nothing stay as they are; documents of which nothing is left go.

    Rows repeated with one id lose the same lines; a null id is an id like others; null texts stay; an empty table stays empty. Other
    columns come back unchanged, whatever their names.
    """
    gone = decisions.where("NOT kept").groupBy(F.col(id_col).alias("k")).agg(F.collect_set("line_no").alias("gone"))
    joined = docs.select(F.struct("*").alias("row")).join(gone, F.col("row")[id_col].eqNullSafe(F.col("k")), "left")
    text = F.col("row")[text_col]
    left = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("gone", i.cast("long")))
    joined = joined.withColumn("left", F.when(F.col("gone").isNotNull(), F.array_join(left, "\n")))
    joined = joined.where(F.col("left").isNull() | (F.trim(F.translate("left", "\t\r\n\x0b\x0c", "     ")) != ""))
    return joined.select(*[(F.coalesce("left", text) if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), short=True)
