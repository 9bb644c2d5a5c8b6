import datetime

import pytest
from pyspark.sql import functions as F

from labelsift.functions import colour, text
from labelsift.functions.numeric import clip_low, left_open_bin, parse_minute, whole_days

COLOURS = [("2.21E+09", "221E07", "sci_repaired"), ("2.00E+69", "200E67", "sci_repaired"), ("9.00E+00", None, "invalid"), ("2-Feb-45", None, "invalid"), ("9999", "009999", "padded"), ("0", "000000", "zero_suspect"), (" c0deed ", "C0DEED", "ok"), (None, None, "invalid"), ("ABCDEF0", None, "invalid")]


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("raw,hex_,status", COLOURS)
def test_colour(spark, raw, hex_, status):
    got = one(spark, raw, colour.repair)
    assert (got.hex, got.status) == (hex_, status)


CLEANED = [("J&amp;amp;J", "J&J"), ("info@site.com", "info@site.com"), ("ig&phhhoto;", "ig&phhhoto;"), (None, ""), ("  \t ", ""), ("_Ùaâ_ x", "a x"), ("a _____ b", "a _____ b"), ("hi @you #tag", "hi MENTIONTOKEN HASHTAGTOKEN")]


@pytest.mark.parametrize("raw,cleaned", CLEANED)
def test_clean(spark, raw, cleaned):
    assert one(spark, raw, text.clean) == cleaned


@pytest.mark.parametrize("raw", ["http//www.bnntv.org", "http:https://t.co/xxxx", "WEBhttp://x"])
def test_links(spark, raw):
    got = one(spark, raw, text.clean)
    assert "URLTOKEN" in got and "http" not in got


def test_long_corrupted_run(spark):
    assert one(spark, "é_" * 40_000 + " end", text.clean) == "end"
    assert one(spark, "é_" * 40_000, lambda x: text.count_of(x, text.CORRUPT)) == 1


def test_unicode_mentions(spark):
    assert one(spark, "@Ùab x@y @z", lambda x: text.count_of(x, text.MENTION)) == 2


def test_numbers(spark):
    assert one(spark, None, lambda x: clip_low(x, 1), "int") is None
    assert [one(spark, v, lambda x: left_open_bin(x, [0, 0.5, 0.9999, 1], ["a", "b", "c"]), "double") for v in (0.0, 0.5, 0.51, 1.0, None, 2.0)] == ["a", "a", "b", "c", None, None]
    assert str(one(spark, "6/24/15 18:05", parse_minute)) == "2015-06-24 18:05:00"
    assert one(spark, "12/1/95 0:00", parse_minute).year == 1995
    assert one(spark, "never", parse_minute) is None


def test_elapsed_days(spark):
    row = spark.sql("SELECT timestamp_ntz '2015-01-01 23:00:00' a, timestamp_ntz '2015-01-02 01:00:00' b").select(whole_days(F.col("a"), F.col("b")).alias("d")).first()
    assert row.d == 0


def test_whole_days_counts_parts_of_seconds(spark):
    day = datetime.timedelta(days=1)
    ends = [datetime.datetime(2030, 1, 1, 7, 30), datetime.datetime(1950, 3, 1, 0, 0, 0, 5)]
    gaps = [k * day + datetime.timedelta(microseconds=us) for k in (-2, -1, 0, 1, 2191) for us in (-1, 0, 1, 600_000, -600_000)]
    rows = [(e - g, e, g // day) for e in ends for g in gaps]
    got = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz, want long").select(whole_days(F.col("a"), F.col("b")).alias("d"), "want")
    assert dict(got.dtypes)["d"] == "bigint" and all(r.d == r.want for r in got.collect())
