"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

One regular expression finds candidates; each is validated (Luhn sum, octets,
calendar dates, IBAN check digits, number areas that exist) and replaced by a
keyed permutation of its own format, so equal values get equal pseudonyms in all
documents and no two values of a format share one:

* card numbers: all digits but the last are permuted, the last is a new Luhn
  digit; separators stay;
* IBANs, compact or printed in fours: country, letters and spaces stay, digits are
  permuted, check digits are new; both spellings of a number stay linked;
* IPv4 addresses: a permutation of the 32-bit values;
* phone numbers: country code (by the numbering plan's prefixes) and punctuation
  stay, the other digits permute, so spaced and compact spellings stay linked;
* social security numbers: a permutation of the valid numbers;
* dates (yyyy-MM-dd, dd/MM/yyyy or else MM/dd/yyyy, dd.MM.yyyy): a permutation
  of the 146,097 days of the years 1800 to 2199.

A permutation is a Feistel network whose halves live in Z_a and Z_b with
a * b = the size of the format; each round adds a SHA-256 of key, kind, round and
the other half, modulo the half's size. It is exactly a bijection, so no cycle
walking is needed. E-mail addresses and secrets (long hexadecimal strings, well
known key prefixes) have no bounded numeric format: they become keyed digests of
the same shape, equal for equal values.

The text is cut at the matches and joined again with the replacements; a text
without digits, ``@`` or key prefixes is not searched at all. There is no
shuffle and no Python.

Edge cases: a null text stays null with no replacements; candidates that fail
validation stay; matches inside longer letter or digit runs do not count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
# The formats searched for, as Java regular expressions. Repeated
# parts without an upper bound are possessive: giving back would recurse.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
HEX = r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}+(?![0-9A-Za-z])"
KEY_PREFIX = r"(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}+|sk-[0-9A-Za-z]{20,}+)(?![0-9A-Za-z])"
IBAN = (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?)"
        r"(?![0-9A-Za-z])")
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
CARD = (r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?<sep>[ -])[0-9]{4}\k<sep>[0-9]{4}\k<sep>[0-9]{4}"
        r"|[0-9]{4}(?<gap>[ -])[0-9]{6}\k<gap>[0-9]{5})(?![0-9A-Za-z])")
PHONE = (r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
         r"|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}([-.])[0-9]{3}[-.][0-9]{4}(?![0-9])"
         # abroad: pairs, 3-4 or 4-4, one long number; and ten digits in pairs after a 0
         r"|(?<![0-9+])\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]\)?(?:[ .-][0-9]{2}){4}|[ .-]?\(?[0-9]{1,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}"
         r"|[ .-]\(?[0-9]{2,5}\)?[ .-]?[0-9]{4,9}|[0-9]{7,12})(?![0-9])"
         r"|(?<![0-9.])0[1-9]([ .-])[0-9]{2}(?:[ .-][0-9]{2}){3}(?![0-9]|\.[0-9])")
COUNTRY_CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})[ .(-]*"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
DATE = (r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])"
        r"|(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9])")
ALL = "|".join(f"(?:{p})" for p in (EMAIL, KEY_PREFIX, HEX, IBAN, IP, CARD, PHONE, SSN, DATE))
#: What a text needs to be searched; every match of ``ALL`` holds it.
MAYBE = r"[0-9@]|gh[pousr]_|sk-|AKIA|ASIA|[a-fA-F]{32}"
FIRST_DAY, DAYS_A, DAYS_B = "1800-01-01", 189, 773  # 189 * 773 = 146,097 days


def _lit(x) -> Column:
    return F.lit(x)


def _digest(key: str, kind: str, *parts) -> Column:
    return F.sha2(F.concat_ws("|", _lit(key), _lit(kind), *(p.cast("string") if isinstance(p, Column) else _lit(str(p))
                                                            for p in parts)), 256)


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str, tweak: Column | None = None) -> Column:
    """A keyed bijection of pairs (left in Z_a, right in Z_b); struct<l, r>."""
    tweak = _lit("") if tweak is None else tweak

    def step(acc: Column, i: Column) -> Column:
        def moved(x: Column, other: Column, size: Column) -> Column:
            number = F.conv(F.substring(_digest(key, kind, tweak, i, other), 1, 15), 16, 10).cast("long")
            return (x + number % size) % size

        return F.when(i % 2 == 0, F.struct(moved(acc["l"], acc["r"], a).alias("l"), acc["r"].alias("r"))).otherwise(
            F.struct(acc["l"].alias("l"), moved(acc["r"], acc["l"], b).alias("r")))

    return F.aggregate(F.array(*map(_lit, range(ROUNDS))),
                       F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A digit string of 1 to 18 digits, permuted among those of its length."""
    def of(d: Column) -> Column:
        n = F.length(d)
        low = F.floor(n / 2).cast("int")
        a, b = (F.pow(_lit(10.0), n - low).cast("long"), F.pow(_lit(10.0), low).cast("long"))
        number = d.cast("long")
        mixed = feistel((number - number % b) / b, number % b, a, b, key, kind, n)
        return _let(mixed, lambda m: F.lpad((m["l"] * b + m["r"]).cast("string"), n, "0"))

    return _let(digits, of)


def only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def refill(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced in order by ``digits``."""
    start = F.struct(_lit("").alias("out"), _lit(1).alias("at"))
    return F.aggregate(
        F.split(template, ""), start,
        lambda acc, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(acc["out"], F.substr(digits, acc["at"], _lit(1))).alias("out"),
                                                           (acc["at"] + 1).alias("at")))
        .otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))),
        lambda acc: acc["out"])


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string, whose last digit is the check digit."""
    def weight(c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        doubled = (F.size(F.split(digits, "")) - i) % 2 == 0  # i from 0; the last counts once
        return F.when(doubled, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(c.cast("int"))

    return F.aggregate(F.transform(F.split(digits, ""), weight), _lit(0), lambda a, x: a + x)


def card(m: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        payload = permute_digits(F.substr(d, _lit(1), F.length(d) - 1), key, "card")
        new = _let(payload, lambda p: F.concat(p, ((10 - luhn_sum(F.concat(p, _lit("0"))) % 10) % 10).cast("string")))
        return F.when(luhn_sum(d) % 10 == 0, refill(m, new)).otherwise(m)

    return _let(only_digits(m), of)


def mod97(x: Column) -> Column:
    """Remainder of an IBAN-style string, letters counting from A = 10."""
    def step(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(x, ""), _lit(0), step)


def iban(m: Column, key: str) -> Column:
    def compact(c: Column) -> Column:
        country, own = F.substring(c, 1, 2), F.substr(c, _lit(5), F.length(c) - 4)

        def of(d: Column) -> Column:
            head, tail = F.substring(d, 1, 15), F.substring(d, 16, 15)
            new = F.concat(F.when(d == "", _lit("")).otherwise(permute_digits(head, key, "iban")),
                           F.when(tail == "", _lit("")).otherwise(permute_digits(tail, key, "iban tail")))
            filled = _let(new, lambda x: refill(own, x))
            return _let(filled, lambda x: F.concat(
                country, F.lpad((98 - mod97(F.concat(x, country, _lit("00")))).cast("string"), 2, "0"), x))

        valid = mod97(F.concat(own, F.substring(c, 1, 4))) == 1
        spelt = _let(_let(only_digits(own), of), lambda x: F.when(m == c, x).otherwise(F.regexp_replace(x, "(.{4})(?=.)", "$1 ")))
        return F.when(valid, spelt).otherwise(m)

    return _let(F.replace(m, _lit(" "), _lit("")), compact)


def ip(m: Column, key: str) -> Column:
    def of(o: Column) -> Column:
        valid = ~F.exists(o, lambda x: (x.cast("int") > 255) | x.rlike("^0[0-9]"))
        number = [F.element_at(o, i).cast("int") for i in (1, 2, 3, 4)]
        size = _lit(65536).cast("long")
        mixed = feistel(number[0] * 256 + number[1], number[2] * 256 + number[3], size, size, key, "ip")
        text = _let(mixed, lambda x: F.concat_ws(".", *(c.cast("long").cast("string") for c in (
            F.shiftright(x["l"], 8), x["l"] % 256, F.shiftright(x["r"], 8), x["r"] % 256))))
        return F.when(valid, text).otherwise(m)

    return _let(F.split(m, r"\."), of)


def phone(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, COUNTRY_CODE, 0)

    def of(h: Column) -> Column:
        rest = F.substr(m, F.length(h) + 1, F.length(m))
        return F.concat(h, refill(rest, permute_digits(only_digits(rest), key, "phone")))

    return _let(head, of)


def ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, *at).cast("int") for at in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    mixed = feistel(area - 1 - (area > 666).cast("int"), (group - 1) * 9999 + serial - 1,
                    _lit(898).cast("long"), _lit(99 * 9999).cast("long"), key, "ssn")

    def text(x: Column) -> Column:
        new_area = x["l"] + 1 + (x["l"] >= 665).cast("int")
        serial_no = x["r"] % 9999
        return F.concat_ws("-", F.lpad(new_area.cast("string"), 3, "0"),
                           F.lpad(((x["r"] - serial_no) / 9999 + 1).cast("long").cast("string"), 2, "0"),
                           F.lpad((serial_no + 1).cast("string"), 4, "0"))

    return F.when(valid, _let(mixed, text)).otherwise(m)


def date(m: Column, key: str) -> Column:
    def as_format(fmt: str) -> Column:
        day = F.try_to_timestamp(m, _lit(fmt)).cast("date")

        def moved(d: Column) -> Column:
            number = F.datediff(d, _lit(FIRST_DAY).cast("date"))
            mixed = feistel((number - number % DAYS_B) / DAYS_B, number % DAYS_B, _lit(DAYS_A).cast("long"),
                            _lit(DAYS_B).cast("long"), key, "date")
            new = _let(mixed, lambda x: F.date_format(
                F.date_add(_lit(FIRST_DAY).cast("date"), (x["l"] * DAYS_B + x["r"]).cast("int")), fmt))
            return F.when((number >= 0) & (number < DAYS_A * DAYS_B), new)

        return _let(day, moved)

    return (F.when(m.contains("-"), F.coalesce(as_format("yyyy-MM-dd"), m))
            .when(m.contains("/"), F.coalesce(as_format("dd/MM/yyyy"), as_format("MM/dd/yyyy"), m))
            .otherwise(F.coalesce(as_format("dd.MM.yyyy"), m)))


def email(m: Column, key: str) -> Column:
    return F.concat(_lit("u"), F.substring(_digest(key, "email", F.lower(m)), 1, 20), _lit("@pseudonym.invalid"))


def secret(m: Column, key: str) -> Column:
    """As many hexadecimal digits as the value has; its prefix (letters before
    ``_`` or ``-``, or the four of an access key id) stays."""
    def of(prefix: Column) -> Column:
        n = F.length(m) - F.length(prefix)
        digest = _digest(key, "secret", F.lower(m))
        new = F.substr(F.repeat(digest, F.ceil(n / 64).cast("int")), _lit(1), n)
        return F.concat(prefix, F.when(m.rlike("^[0-9]+$"), F.translate(new, "abcdef", "012345"))
                        .when(m == F.upper(m), F.upper(new)).otherwise(new))

    return _let(F.regexp_extract(m, "^(gh[pousr]_|sk-|AKIA|ASIA)", 1), of)


def pseudonym(m: Column, key: str) -> Column:
    """The replacement of one match; the match itself if it is not valid."""
    def full(pattern: str) -> Column:
        return m.rlike(f"^(?:{pattern})$")

    return (F.when(m.contains("@"), email(m, key))
            .when(full(HEX) | full(KEY_PREFIX), secret(m, key))
            .when(full(IBAN), iban(m, key))
            .when(full(IP), ip(m, key))
            .when(full(CARD), card(m, key))
            .when(full(SSN), ssn(m, key))
            .when(full(DATE), date(m, key))
            .otherwise(phone(m, key)))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_replaced") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; all other columns
    stay. ``count_col`` (if named) gets the number of replaced values."""
    taken = set(docs.columns)
    found, gaps, new = (next(n for i in range(len(taken) + 1) if (n := f"{name}_{i}") not in taken)
                        for name in ("found", "gaps", "new"))
    text = F.col(f"`{text_col}`")
    maybe = F.coalesce(text.rlike(MAYBE), _lit(False))
    empty = F.array().cast("array<string>")
    out = docs.withColumn(found, F.when(maybe, F.regexp_extract_all(text, _lit(ALL), _lit(0))).otherwise(empty))
    out = out.withColumn(new, F.transform(found, lambda m: pseudonym(m, key)))
    joined = F.array_join(F.zip_with(F.split(text, ALL, -1), F.col(new), lambda g, r: F.concat(g, F.coalesce(r, _lit("")))), "")
    replaced = F.size(F.filter(F.arrays_zip(F.col(found).alias("o"), F.col(new).alias("n")), lambda p: p["o"] != p["n"]))
    columns = [F.when(F.size(found) > 0, joined).otherwise(text).alias(text_col) if c == text_col else F.col(f"`{c}`")
               for c in docs.columns if c != count_col]
    return out.select(*columns, *([replaced.alias(count_col)] if count_col else []))
