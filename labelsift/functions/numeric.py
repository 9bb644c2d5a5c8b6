"""Numbers with the null rules of a data frame library: comparisons with null are false, clipping keeps null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def flag(condition: Column) -> Column:
    """1 if true, else 0; null is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def clip_low(x: Column, low: float) -> Column:
    """Values under ``low`` become ``low``; null stays null (``greatest`` would lose it)."""
    return F.when(x < low, F.lit(low)).otherwise(x)


def rate(count: Column, days: Column) -> Column:
    """Per day, a day at least."""
    return count / clip_low(days, 1)


def left_open_bin(x: Column, edges: list[float], names: list[str]) -> Column:
    """(e0, e1], (e1, e2], ...; the first bin holds e0 too. Null outside."""
    out = F.when((x >= edges[0]) & (x <= edges[1]), names[0])
    for low, high, name in zip(edges[1:], edges[2:], names[1:], strict=False):
        out = out.when((x > low) & (x <= high), name)
    return out


def whole_days(start: Column, end: Column) -> Column:
    """Elapsed 24-hour periods, rounded down, exact to the microsecond; calendar days play no part. Timestamps are taken as UTC."""
    gap = end - start
    days = F.extract(F.lit("DAY"), gap)  # towards zero
    return days.cast("long") - (F.make_dt_interval(days) > gap).cast("long")


def parse_minute(text: Column) -> Column:
    """'6/24/15 18:05' as a timestamp without zone; null if it doesn't parse. Years 69 to 99 are of the last century."""
    year = F.regexp_extract(text, r"^\d{1,2}/\d{1,2}/(\d{2}) ", 1)
    day, rest = F.regexp_extract(text, r"^(\d{1,2}/\d{1,2}/)", 1), F.regexp_extract(text, r"^\d{1,2}/\d{1,2}/(.*)$", 1)
    full = F.when(year != "", F.concat(day, F.when(year >= "69", "19").otherwise("20"), rest))
    return F.try_to_timestamp(full, F.lit("M/d/yyyy H:mm")).cast("timestamp_ntz")


def close(a: Column, b: Column, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    return F.abs(a - b) <= absolute + relative * F.abs(b)


def recode(x: Column, table: dict) -> Column:
    """Values by a table; what isn't in it becomes null."""
    return reduce(lambda c, kv: c.when(x == kv[0], F.lit(kv[1])), list(table.items())[1:], F.when(x == next(iter(table)), F.lit(next(iter(table.values())))))


def case(*branches: tuple[Column, object], otherwise: object = None) -> Column:
    """First condition that holds wins; null conditions don't."""
    out = F
    for condition, value in branches:
        out = out.when(condition, value if isinstance(value, Column) else F.lit(value))
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def half_even(x: Column, places: int = 0) -> Column:
    return F.bround(x, places)


def threshold_flag(x: Column) -> Column:
    """1 from 1 on, 0 up to 0; null between and for null."""
    return F.when(x >= 1, 1).when(x <= 0, 0)
