"""Repair of colour codes that a spreadsheet damaged, as one CASE expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The states a code can be in.
OK, PADDED, SCIENTIFIC, ZERO, INVALID = "ok", "padded", "sci_repaired", "zero_suspect", "invalid"
_EXPONENT = r"^([0-9])\.([0-9]{2})E\+([0-9]{2})$"


def normal(raw: Column) -> Column:
    """Upper-cased without outer white space; null reads as the text 'NAN'."""
    return F.upper(F.regexp_replace(F.coalesce(raw.cast("string"), F.lit("nan")), r"^\s+|\s+$", ""))


def repair(raw: Column) -> Column:
    """struct(hex, status). d.ddE+xx is the code dddE(xx-2) read as a number; 1 to 5 digits lost their leading zeros."""
    code = normal(raw)
    power = F.regexp_extract(code, _EXPONENT, 3)
    value = F.when(power == "", F.lit(-1)).otherwise(power.cast("int"))
    rebuilt = F.concat(F.regexp_extract(code, _EXPONENT, 1), F.regexp_extract(code, _EXPONENT, 2), F.lit("E"), F.lpad((value - 2).cast("string"), 2, "0"))

    def answer(hex_: Column, status: str) -> Column:
        return F.struct(hex_.alias("hex"), F.lit(status).alias("status"))

    return (
        F.when(code == "0", answer(F.lit("000000"), ZERO))
        .when(value >= 2, answer(rebuilt, SCIENTIFIC))
        .when(code.rlike("^[0-9A-F]{6}$"), answer(code, OK))
        .when(code.rlike("^[0-9A-F]{1,5}$"), answer(F.lpad(code, 6, "0"), PADDED))
        .otherwise(answer(F.lit(None).cast("string"), INVALID))
    )


def channel(hex_: Column, k: int) -> Column:
    """Channel 0 (red), 1 (green) or 2 (blue) of six hexadecimal digits."""
    return F.conv(F.substring(hex_, 2 * k + 1, 2), 16, 10).cast("int")


def brightness(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def features(raw: Column, prefix: str) -> dict[str, Column]:
    """The eight columns of a colour."""
    fixed = repair(raw)
    r, g, b = (channel(fixed["hex"], k) for k in range(3))
    return {
        f"{prefix}_hex": fixed["hex"],
        f"{prefix}_r": r,
        f"{prefix}_g": g,
        f"{prefix}_b": b,
        f"{prefix}_brightness": brightness(r, g, b),
        f"{prefix}_status": fixed["status"],
        f"{prefix}_usable": (fixed["status"] != INVALID).cast("int"),
        f"{prefix}_zero_suspect": (fixed["status"] == ZERO).cast("int"),
    }
