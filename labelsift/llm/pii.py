"""Format-preserving pseudonyms by keyed Feistel permutations, in DataFrame functions only.

A value is found by a pattern, validated, and written as a pair (left, right) of a domain A x B that has exactly the valid values of
its format: card numbers without their check digit, the four octets of an address, the days of two hundred years and so on. ROUNDS
rounds add a keyed hash of one half to the other, modulo its size; that is a permutation of the domain, so pseudonyms are
valid in the same format, equal values get equal pseudonyms in every document and different values different ones. Names in
e-mail addresses and hexadecimal secrets are permuted letter by letter within their class (digit, small letter, capital), the
halves of the string being the halves of the Feistel network.

The text is cut at the matches, each match is replaced, and the pieces are joined again: one pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelsift.llm.common import table

#: For tests and the registered query only; deployments pass a secret of their own.
KEY = "replace this key"
ROUNDS = 8

#: Patterns in order of precedence. Java syntax; Unicode letters count in addresses' names.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "token": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,255}|AIza[0-9A-Za-z_-]{35}|sk-[0-9A-Za-z_-]{20,200}|xox[abprs]-[0-9A-Za-z-]{10,200})(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{32,128}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?=[A-F]*\d)(?=\d*[A-F])[0-9A-F]{32,128}(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}:(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d(+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d+])\+\d{1,3}[ .-]\d(?:[ .-]\d{2,4}){2,5}(?!\d)|(?<![\d.,+-])0\d(?:[ .-]\d{2}){4}(?![\d]|[ .-]\d)",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d]|[.-]\d)",
}
#: What issuers' access tokens begin with; it stays.
TOKEN_PREFIX = "^((?:AKIA|ASIA|gh[pousr]_|AIza|sk-|xox[abprs]-))"
FIRST_YEAR, LAST_YEAR = 1900, 2099
#: Days of these years, as a product of two numbers.
DAYS = (17, 4297)
#: Valid area-group pairs (areas 001 to 899 without 666, groups 01 to 99) and serials.
SSN = (898 * 99, 9999)


def _hash(key: str, kind: str, round_no: Column, half: Column) -> Column:
    """48 bits of a keyed hash."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), round_no.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def permute(left: Column, right: Column, a: Column, b: Column, key: str, kind: str, rounds: int = ROUNDS) -> Column:
    """The struct (l, r) that a keyed permutation of [0, a) x [0, b) gives."""

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        f = _hash(key, kind, i, F.when(even, s["r"]).otherwise(s["l"]))
        return F.struct(
            F.when(even, F.pmod(s["l"] + f, a)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + f, b)).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _number(text: Column) -> Column:
    return F.coalesce(text.cast("long"), F.lit(0))


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A permutation of the strings of as many digits, 2 to 36; the halves are numbers."""
    n = F.length(digits)
    low = F.floor(n / 2).cast("int")
    left, right = F.substring(digits, F.lit(1), low), F.substring(digits, low + 1, n - low)
    a, b = F.pow(F.lit(10.0), low).cast("long"), F.pow(F.lit(10.0), n - low).cast("long")
    domain = F.concat(F.lit(kind), n.cast("string"))
    out = permute(_number(left), _number(right), a, b, key, kind)
    return _let(F.struct(out.alias("o"), domain.alias("d")), lambda s: F.concat(F.lpad(s["o"]["l"].cast("string"), low, F.lit("0")), F.lpad(s["o"]["r"].cast("string"), n - low, F.lit("0"))))


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(template: Column, digits: Column) -> Column:
    """The template with its digits replaced in order."""
    return F.aggregate(
        F.split(template, ""),
        F.struct(F.lit("").alias("s"), F.lit(1).alias("i")),
        lambda st, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(st["s"], F.substring(digits, st["i"], F.lit(1))).alias("s"), (st["i"] + 1).alias("i"))).otherwise(
            F.struct(F.concat(st["s"], c).alias("s"), st["i"].alias("i"))
        ),
        lambda st: st["s"],
    )


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a number whose last digit is doubled, as for the digits before the check digit."""
    reversed_ = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    parts = F.transform(reversed_, lambda c, i: F.when(i % 2 == 0, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5)).otherwise(c.cast("int")).cast("int"))
    return F.aggregate(parts, F.lit(0), lambda s, x: s + x)


def _card(text: Column, key: str) -> Column:
    def of(digits: Column) -> Column:
        body = F.substring(digits, F.lit(1), F.length(digits) - 1)
        valid = (luhn_sum(body) + F.substring(digits, -1, 1).cast("int")) % 10 == 0
        fresh = _let(permute_digits(body, key, "card"), lambda b: F.concat(b, F.pmod(-luhn_sum(b), F.lit(10)).cast("string")))
        return F.when(valid, _refill(text, fresh))

    return _let(_only_digits(text), of)


def _mod97(text: Column) -> Column:
    """An IBAN's number modulo 97, letters standing for 10 to 35."""
    return F.aggregate(
        F.filter(F.split(text, ""), lambda c: c != ""),
        F.lit(0).cast("long"),
        lambda s, c: F.when(c.rlike("[A-Z]"), (s * 100 + F.ascii(c) - 55) % 97).otherwise((s * 10 + F.ascii(c) - 48) % 97).cast("long"),
    )


def _iban(text: Column, key: str) -> Column:
    """Groups stay as they are written; letters stay, digits move, the check digits are made anew."""
    return _let(F.replace(text, F.lit(" "), F.lit("")), lambda t: _let(_compact_iban(t, key), lambda fresh: _refill(text, _only_digits(fresh))))


def _compact_iban(text: Column, key: str) -> Column:
    country, body = F.substring(text, 1, 2), F.substring(text, F.lit(5), F.length(text) - 4)
    valid = _mod97(F.concat(body, F.substring(text, 1, 4))) == 1
    digits = _only_digits(body)
    fresh = F.when(F.length(digits) >= 2, _refill(body, permute_digits(digits, key, "iban")))
    return F.when(valid, _let(fresh, lambda b: F.concat(country, F.lpad((F.lit(98) - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b)))


def _ip(text: Column, key: str) -> Column:
    def of(p: Column) -> Column:
        octet = [p[k].cast("int") for k in range(4)]
        valid = (octet[0] <= 255) & (octet[1] <= 255) & (octet[2] <= 255) & (octet[3] <= 255)
        out = permute(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], F.lit(65536), F.lit(65536), key, "ip")
        return F.when(valid, _let(out, lambda o: F.concat_ws(".", *[(F.floor(o[h] / 256) if hi else o[h] % 256).cast("string") for h in ("l", "r") for hi in (True, False)])))

    return _let(F.split(text, "\\."), of)


def _ipv6(text: Column, key: str) -> Column:
    """Each digit becomes a digit, each letter a letter; of addresses with a digit and three groups, so that no word with colons is taken."""
    groups = F.size(F.filter(F.split(text, ":"), lambda g: g != ""))
    return F.when((groups >= 3) & text.rlike("[0-9]"), permute_letters(text, key, "ipv6", True))


def _token(text: Column, key: str) -> Column:
    prefix = F.regexp_extract(text, TOKEN_PREFIX, 1)
    return F.when(text.rlike("[0-9]"), F.concat(prefix, permute_letters(F.substring(text, F.length(prefix) + 1, F.length(text)), key, "token")))


def _moved_day(day: Column, key: str) -> Column:
    out = permute(F.floor(day / DAYS[1]), day % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), key, "date")
    return _let(out, lambda o: (o["l"] * DAYS[1] + o["r"]).cast("int"))


def _date(text: Column, key: str) -> Column:
    """Dates of four written forms; the form stays. Between strokes the month comes first if that is a date, else the day: of such days, after
    the 12th, the permutation is applied until it gives another of these, so they are permuted among themselves."""
    year_first, dots = text.rlike("^\\d{4}"), text.rlike("\\.")
    start = F.lit(f"{FIRST_YEAR}-01-01").cast("date")

    def number(iso: Column) -> Column:
        day = F.datediff(iso.try_cast("date"), start)
        return F.when((day >= 0) & (day < DAYS[0] * DAYS[1]), day)

    def turned(order: str) -> Column:
        return F.regexp_replace(text, "(\\d{2}).(\\d{2}).(\\d{4})", order)

    def late(day: Column) -> Column:
        return F.dayofmonth(F.date_add(start, day)) > 12

    def walked(day: Column) -> Column:
        # two in five dates are on a 12th or before: 100 steps always suffice
        return F.aggregate(F.sequence(F.lit(1), F.lit(100)), _moved_day(day, key), lambda s, _: F.when(late(s), s).otherwise(_moved_day(s, key)))

    plain = number(F.when(year_first, F.regexp_replace(text, "/", "-")).when(dots, turned("$3-$2-$1")).otherwise(turned("$3-$1-$2")))
    # formats by hand: date_format wants a constant pattern
    written = _let(
        F.date_add(start, _moved_day(plain, key)),
        lambda d: F.when(text.rlike("^\\d{4}-"), F.date_format(d, "yyyy-MM-dd")).when(year_first, F.date_format(d, "yyyy/MM/dd")).when(dots, F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy")),
    )
    day_first = F.when(~year_first & ~dots, number(turned("$3-$2-$1")))
    return F.when(plain.isNotNull(), written).when(day_first.isNotNull(), F.date_format(F.date_add(start, walked(day_first)), "dd/MM/yyyy"))


def _ssn(text: Column, key: str) -> Column:
    area, group, serial = (F.substring(text, p, n).cast("int") for p, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    place = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1

    def written(o: Column) -> Column:
        a = F.floor(o["l"] / 99)
        return F.concat_ws("-", F.lpad((a + F.when(a >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((o["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((o["r"] + 1).cast("string"), 4, "0"))

    return F.when(valid, _let(permute(place, serial - 1, F.lit(SSN[0]), F.lit(SSN[1]), key, "ssn"), written))


def _phone(text: Column, key: str) -> Column:
    """The country code stays; the other digits, 7 or more, are permuted."""
    code = F.when(text.rlike("^\\+\\d{1,3}[ .(-]"), F.regexp_extract(text, "^(\\+\\d{1,3}[ .-]?)", 1)).otherwise(F.when(text.startswith("+"), F.substring(text, 1, 2)).otherwise(F.lit("")))
    rest = F.substring(text, F.length(code) + 1, F.length(text) - F.length(code))
    digits = _only_digits(rest)
    return F.when(F.length(digits).between(7, 18), F.concat(code, _refill(rest, permute_digits(digits, key, "phone"))))


def permute_letters(text: Column, key: str, kind: str, hexadecimal: bool = False, rounds: int = 6) -> Column:
    """A permutation of the strings of the same pattern of digits, small letters, capitals and à-ÿ; other signs stay. One sign stays as
    it is in a string of one."""
    radix = 6 if hexadecimal else 26
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    n = F.size(codes)
    half = F.floor(n / 2).cast("int")

    def shift(code: Column, by: Column) -> Column:
        def turn(base: int, size: int) -> Column:
            return F.lit(base) + F.pmod(code - base + by, F.lit(size))

        return F.when(code.between(48, 57), turn(48, 10)).when(code.between(97, 96 + radix), turn(97, radix)).when(code.between(65, 64 + radix), turn(65, radix)).when(code.between(0xE0, 0xF6), turn(0xE0, 23)).otherwise(code).cast("int")

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), n.cast("string"), F.array_join(F.when(even, s["r"]).otherwise(s["l"]), ",")), 512)

        def turned(part: Column) -> Column:
            return _let(stream, lambda h: F.transform(part, lambda c, j: shift(c, F.conv(F.substring(h, (j % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int"))))

        return F.struct(F.when(even, turned(s["l"])).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(turned(s["r"])).alias("r"))

    start = F.struct(F.slice(codes, F.lit(1), half).alias("l"), F.slice(codes, half + 1, F.greatest(n - half, F.lit(0))).alias("r"))
    swept = F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))
    return F.array_join(F.transform(swept, lambda c: _character(c)), "")


def _character(code: Column) -> Column:
    """``chr`` for any code point (Spark's own wraps at 256 and knows Latin-1 only)."""
    return F.when(code < 256, F.call_function("chr", code)).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def _email(text: Column, key: str) -> Column:
    return F.concat(permute_letters(F.substring_index(text, "@", 1), key, "email"), F.lit("@"), F.substring_index(text, "@", -1))


def pseudonym(text: Column, key: str) -> Column:
    """(kind, text) of a match; kind is null, and the text unchanged, if no format finds it valid."""

    def whole(kind: str) -> Column:
        return text.rlike("^(?:" + PATTERNS[kind] + ")$")

    tries = [("email", _email), ("iban", _iban), ("token", _token), ("secret", lambda t, k: permute_letters(t, k, "secret", True)), ("ip", _ip), ("ipv6", _ipv6), ("date", _date), ("ssn", _ssn), ("phone", _phone), ("card", _card)]
    found = None
    for kind, make in tries:
        value = F.when(whole(kind), make(text, key))
        one = F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.alias("text")))
        found = one if found is None else F.coalesce(found, one)
    return F.coalesce(found, F.struct(F.lit(None).cast("string").alias("kind"), text.alias("text")))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All columns and rows of ``docs``, the text with its personal data replaced, and two columns more: n_replaced and kinds, the distinct
    kinds in order. Columns of these names are replaced; others come back unchanged, whatever their names.

    A null text stays null, with no replacements; texts without a match stay as they are, byte for byte. Overlapping
    candidates go to the leftmost, then by the order of PATTERNS. Repeated rows are treated alike; an empty table gives no rows. A mail's domain
    stays, and a name of one letter can't move.
    """
    union = "|".join(f"(?:{p})" for p in PATTERNS.values())
    base = docs.drop("n_replaced", "kinds")
    packed = base.select(F.struct("*").alias("row"))
    text = F.col("row")[text_col]
    # every pattern needs a digit or an at sign
    matches = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(union), F.lit(0)))
    cut = packed.withColumn("new", F.transform(matches, lambda m: pseudonym(m, key)))
    some = F.coalesce(F.size(F.filter("new", lambda x: x["kind"].isNotNull())), F.lit(0)) > 0
    gaps = F.split(text, union, -1)
    pieces = F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col("new"), i)["text"], F.lit(""))))
    kinds = F.filter(F.transform("new", lambda x: x["kind"]), lambda k: k.isNotNull())
    return cut.select(
        *[(F.when(some, F.array_join(pieces, "")).otherwise(text) if c == text_col else F.col("row")[c]).alias(c) for c in base.columns],
        F.when(some, F.size(kinds)).otherwise(0).alias("n_replaced"),
        F.when(some, F.array_sort(F.array_distinct(kinds))).otherwise(F.array().cast("array<string>")).alias("kinds"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
    return found.select("doc_id", "n_replaced", F.array_join("kinds", ",").alias("kinds"), "text")
