"""Offset-mapped token counts of fields or sections.

A document is encoded once, whole. The byte lengths of its tokens give their character spans; the spans of
its fields or sections, in order and disjoint, are joined to them by a merge of sorted interval ends. A token that crosses a
boundary is allotted by a rule: "start" to the span of its first character, "end" to that of its last, "most" to the span with
most of its characters (the first of equals), "share" to each span by its share of the characters, in exact 1/SHARES units.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from labelsift.llm.common import table

#: A tiktoken file of ranks and its splitting pattern (both public).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "end", "most", "share")
#: Output rows of a batch, roughly.
ROWS = 100_000

_encoders: dict[int, tuple] = {}


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _encoder(key: int, ranks: dict[bytes, int], pattern: str) -> tuple:
    """The encoding and its tokens' byte lengths, built once in each Python worker."""
    if key not in _encoders:
        import tiktoken

        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _encoders.clear()
        _encoders[key] = tiktoken.Encoding("attribution", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _encoders[key]


def token_spans(text: str, encoder: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Character starts and ends of a text's tokens. A token that begins or ends inside a character counts the whole of it."""
    encoding, lengths = encoder
    ends = np.cumsum(lengths[encoding.encode_ordinary(text)])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
    if len(text) == (ends[-1] if len(ends) else 0):
        return starts, ends
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    # number of the character that each byte belongs to
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    return char[starts], char[ends - 1] + 1


def allot(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing) of spans [low, high): tokens allotted, and tokens that reach over an edge of the span."""
    n = len(low)
    tokens, crossing = np.zeros(n, np.float64), np.zeros(n, np.int64)
    if not n or not len(starts):
        return tokens, crossing
    # spans that a token touches: from the first that ends after its start to the last that begins before its end
    first, last = np.searchsorted(high, starts, "right"), np.searchsorted(low, ends, "left") - 1
    inside = (first == last) & (first < n)
    one = np.flatnonzero(inside)
    held = (starts[one] >= low[first[one]]) & (ends[one] <= high[first[one]])
    tokens += np.bincount(first[one[held]], minlength=n)
    for t in [*one[~held].tolist(), *np.flatnonzero(first < last).tolist()]:
        a, b = int(first[t]), int(last[t])
        common = np.minimum(high[a : b + 1], ends[t]) - np.maximum(low[a : b + 1], starts[t])
        touched = np.flatnonzero(common > 0)
        crossing[a + touched] += 1
        if rule == "share":
            tokens[a : b + 1] += np.maximum(common, 0) / (ends[t] - starts[t])
        elif rule == "most":
            # what lies in no span is a span of its own
            rest = ends[t] - starts[t] - common[touched].sum()
            if len(touched) and common.max() >= rest:
                tokens[a + int(np.argmax(common))] += 1
        else:
            point = starts[t] if rule == "start" else ends[t] - 1
            k = int(np.searchsorted(high, point, "right"))
            if k < n and low[k] <= point:
                tokens[k] += 1
    return tokens, crossing


def allot_any(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """allot for spans in any order that may overlap: each keeps what no span before it, by start and end, has."""
    order = np.lexsort((high, low))
    high = np.maximum(low, high)[order]
    reach = np.concatenate([[0], np.maximum.accumulate(high)])[:-1]
    low = np.maximum(low[order], reach)
    tokens, crossing = np.zeros(len(order)), np.zeros(len(order), np.int64)
    tokens[order], crossing[order] = allot(starts, ends, low, np.maximum(low, high), rule)
    return tokens, crossing


def line_sections(text: str) -> tuple[list[str], list[int], list[int]]:
    """Numbered lines; a line feed belongs to the line that it ends."""
    ends, at = [], 0
    for line in text.split("\n"):
        at += len(line) + 1
        ends.append(at)
    ends[-1] -= 1
    return [str(k) for k in range(len(ends))], [0, *ends[:-1]], ends


def section_tokens(docs: DataFrame, spans_col: str | None = None, rule: str = "start", id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(id, section, char_start, char_end, n_tokens, n_crossing, doc_tokens): one row per document and section.

    Sections are lines, or ``spans_col``: an array of structs (name, start, end) of character ranges in any order; ranges are
    cut to the text, and empty ones get a row with 0 tokens. Characters that several ranges hold belong to the one that begins first, or of these ends first. Tokens of no span count in doc_tokens only. n_tokens is a double, whole unless the rule is "share".
    A null or empty text has one empty line; with a null array there are no rows. Repeated rows each get their rows; other columns are ignored;
    an empty table gives no rows. Texts of any length are encoded whole.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ranks = load_ranks(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    key = hash((vocabulary, pattern))
    kind = docs.schema[id_col].dataType.simpleString()
    columns = [F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")]
    if spans_col:
        columns.append(F.col(spans_col).cast("array<struct<name:string,start:long,end:long>>").alias("spans"))

    def read(batches):
        encoder = _encoder(key, shared.value, pattern)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]

            def flush():
                flat = [np.concatenate(c) if k in (2, 3, 4, 5) else c for k, c in enumerate(out)]
                made = pa.RecordBatch.from_arrays(
                    [pa.array(flat[0], batch.schema.field(0).type), pa.array(flat[1], pa.string()), *(pa.array(flat[k].astype(np.int64)) for k in (2, 3)), pa.array(flat[4]), pa.array(flat[5]), pa.array(flat[6], pa.int64())],
                    ["id", "section", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens"],
                )
                for c in out:
                    c.clear()
                return made

            ids = batch.column(0).to_pylist()
            given = batch.column(2).to_pylist() if spans_col else None
            for j, cell in enumerate(batch.column(1)):
                text = cell.as_py()
                if given is None:
                    names, low, high = line_sections(text)
                else:
                    spans = given[j] or []
                    names = [s["name"] for s in spans]
                    low, high = ([min(max(s[e] or 0, 0), len(text)) for s in spans] for e in ("start", "end"))
                if not names:
                    continue
                starts, ends = token_spans(text, encoder)
                low, high = np.array(low, np.int64), np.array(high, np.int64)
                tokens, crossing = allot_any(starts, ends, low, high, rule)
                for c, v in zip(out, ([ids[j]] * len(names), names, low, high, tokens, crossing, [len(starts)] * len(names)), strict=True):
                    c.append(v) if isinstance(v, np.ndarray) else c.extend(v)
                if len(out[0]) >= ROWS:
                    yield flush()
            if out[0]:
                yield flush()

    made = docs.select(*columns).mapInArrow(read, f"id {kind}, section string, char_start long, char_end long, n_tokens double, n_crossing long, doc_tokens long")
    return made.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = section_tokens(table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.col("section").cast("long").alias("line_no"), "char_start", "char_end", F.col("n_tokens").cast("long").alias("n_tokens"), "n_crossing", "doc_tokens")
