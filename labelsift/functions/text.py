"""Cleaning and counting of message text as Column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, functions as F

#: What counts as a link, a bare scheme, a mention, a hashtag and a corrupted run. (?U) makes classes
#: Unicode-aware; the corrupted run is possessive so that long runs can't exhaust the stack.
URL = r"(?iU)(?:https?:?//|www\.)\S*"
SCHEME = r"(?iU)\bhttps?\b:?"
MENTION = r"(?U)(?<!\w)@\w+"
HASHTAG = r"(?U)#\w+"
CORRUPT = r"_*+(?:[^\x00-\x7F]_*+)++"
SPACE = r"(?U)\s+"
URL_TOKEN, MENTION_TOKEN, HASHTAG_TOKEN = "URLTOKEN", "MENTIONTOKEN", "HASHTAGTOKEN"
UNESCAPE_ROUNDS = 5


def _unescape(text: str | None) -> str | None:
    for _ in range(UNESCAPE_ROUNDS if text and "&" in text else 0):
        plain = html.unescape(text)
        if plain == text:
            break
        text = plain
    return text


def _unescape_batch(texts: pd.Series) -> pd.Series:
    return texts.map(_unescape, na_action="ignore")


def unescape(text: Column) -> Column:
    """HTML entities replaced until nothing changes, five rounds at most. Of rows without "&", only a null goes to Python."""
    batch = F.pandas_udf(_unescape_batch, "string")
    marked = F.contains(text, F.lit("&"))
    return F.when(marked, batch(F.when(marked, text))).otherwise(text)


def clean(text: Column, entities: bool = True) -> Column:
    """The cleaning cascade; null becomes ''. ``entities`` off skips the entity step, the one that needs Python."""
    out = F.coalesce(text, F.lit(""))
    out = unescape(out) if entities else out
    for pattern, token in ((URL, URL_TOKEN), (SCHEME, URL_TOKEN), (MENTION, MENTION_TOKEN), (HASHTAG, HASHTAG_TOKEN)):
        out = F.regexp_replace(out, pattern, f" {token} ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, CORRUPT, " "), SPACE, " "))


def count_of(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def word_count(cleaned: Column) -> Column:
    """Words of a cleaned text, which has single spaces only."""
    return F.when(cleaned == "", 0).otherwise(F.size(F.split(cleaned, " "))).cast("long")


def features(raw: Column, prefix: str, entities: bool = True) -> dict[str, Column]:
    """The nine text columns of a prefix. Counts of links, mentions, hashtags and corrupted runs are of the raw text."""
    raw = F.coalesce(raw, F.lit(""))
    cleaned = clean(raw, entities)
    return {
        f"{prefix}_raw": raw,
        f"{prefix}_clean": cleaned,
        f"has_{prefix}": raw.rlike(r"(?U)\S").cast("int"),
        f"{prefix}_len": F.char_length(cleaned).cast("long"),
        f"{prefix}_word_count": word_count(cleaned),
        f"{prefix}_n_urls": count_of(raw, URL),
        f"{prefix}_n_mentions": count_of(raw, MENTION),
        f"{prefix}_n_hashtags": count_of(raw, HASHTAG),
        f"{prefix}_n_mojibake": count_of(raw, CORRUPT),
    }


def compact(x: Column) -> Column:
    """1234 as '1.2k', 2500000 as '2.5M'."""
    size = F.abs(x)
    return F.when(size >= 1_000_000, F.concat(F.format_string("%.1f", x / 1e6), F.lit("M"))).when(size >= 1000, F.concat(F.format_string("%.1f", x / 1e3), F.lit("k"))).otherwise(F.format_string("%.0f", x.cast("double")))
