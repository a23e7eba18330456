"""Personal data replaced by format-preserving pseudonyms. DataFrame operations only.

Validated card numbers (Luhn), phone numbers, IPv4 addresses, dates, social
security numbers and mail addresses are replaced by values of the same format
through keyed Feistel networks, so the same value has the same pseudonym in all
documents and different values have different ones:

* cards (all but the check digit, which is made anew), the last ten digits of
  phone numbers and the local parts of mail addresses are character strings: two
  halves take turns in being shifted, letter by letter and digit by digit, by a
  keyed hash of the other half;
* addresses, dates (the 146,097 days of 1800 to 2199, a whole calendar cycle)
  and social security numbers are numbers below a product a * b: the two places
  take turns in being shifted by a keyed hash of the other.

A date with slashes is read day first; one that only makes sense month first
(its day is above 12) becomes another such date, permuted among the 88,497 of
them, so no two dates of one format share a pseudonym. ISO dates and day-first
dates of one day are linked with each other.

Values that fail their test stay as they are. The key comes from the caller, or
from the session's ``spark.evalpack.pii.key``; without either each call draws a
key of its own, so values are linked within its result only. Whoever has the
key can undo the pseudonyms.

Defined results: a null text stays null, an empty one empty; repeated rows are
each replaced alike; values overlap nowhere (the leftmost match wins); a mail
address is compared by its lower-case form; an empty table gives an empty
result; other columns are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, read

KEY, ROUNDS = "spark.evalpack.pii.key", 8

_MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
_IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
_DATE = r"(?<![0-9/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_PHONE = (r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
          r"|(?<![0-9.-])(?:\+?[0-9]{1,3}[ .-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-]?[0-9])|\+[0-9]{10,15}(?![0-9])")
_CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
#: In the order in which they are tried at a place.
PATTERNS = {"email": _MAIL, "ip": _IP, "date": _DATE, "ssn": _SSN, "phone": _PHONE, "card": _CARD}


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it occurs in it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)


def _number(key: str, kind: str, value: Column, a: int, b: int) -> Column:
    """A keyed permutation of the whole numbers below a * b."""
    def turn(s: Column, i: Column) -> Column:
        def moved(x: str, other: str, size: int, odd: int) -> Column:
            by = F.conv(F.substring(_hash(key, F.lit(kind), i, s[other]), 1, 15), 16, 10).cast("long")
            return F.when(i % 2 == odd, F.pmod(s[x] + by, F.lit(size).cast("long"))).otherwise(s[x]).alias(x)
        return F.struct(moved("l", "r", a, 0), moved("r", "l", b, 1))

    first = F.struct(F.floor(value / b).cast("long").alias("l"), (value % b).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), first, turn, lambda s: s["l"] * b + s["r"])


def _shifted(text: Column, by: Column) -> Column:
    """Letters (lower case) and digits of ``text`` shifted by the hex digits ``by``; other characters stay."""
    def one(i: Column) -> Column:
        return _let(F.substr(text, i, F.lit(1)), lambda c: _let(
            F.conv(F.substr(by, (i - 1) % 30 * 2 + 1, F.lit(4)), 16, 10).cast("int"), lambda step: moved(c, F.ascii(c), step)))

    def moved(c: Column, code: Column, step: Column) -> Column:
        return (F.when(code.between(48, 57), F.char(48 + (code - 48 + step) % 10))
                .when(code.between(97, 122), F.char(97 + (code - 97 + step) % 26)).otherwise(c))
    return F.when(F.length(text) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), ""))


def _string(key: str, kind: str, value: Column) -> Column:
    """A keyed permutation of the strings of the same format (kind of each character)."""
    def turn(s: Column, i: Column) -> Column:
        def moved(x: str, other: str, odd: int) -> Column:
            by = _hash(key, F.lit(kind), i, F.length(s[x]), s[other])
            return F.when(i % 2 == odd, _let(by, lambda b: _shifted(s[x], b))).otherwise(s[x]).alias(x)
        return F.struct(moved("l", "r", 0), moved("r", "l", 1))

    half = F.floor(F.length(value) / 2).cast("int")
    first = F.struct(F.substr(value, F.lit(1), half).alias("l"), F.substr(value, half + 1, F.length(value)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), first, turn, lambda s: F.concat(s["l"], s["r"]))


def _luhn_sum(digits: Column, odd: int) -> Column:
    """Sum of the digits, every second one doubled; ``odd``: whether the last one is."""
    def one(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return F.when((F.length(digits) - i) % 2 == 1 - odd, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), one), F.lit(0), lambda a, x: a + x)


def _in_format(m: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of ``m``."""
    def one(i: Column) -> Column:
        c = F.substr(m, i, F.lit(1))
        return F.when(c.between("0", "9"), F.substr(digits, F.length(_digits(F.substr(m, F.lit(1), i))), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), one), "")


def _card(m: Column, key: str) -> tuple[Column, Column]:
    d = _digits(m)
    check = lambda body: ((10 - _luhn_sum(body, 1) % 10) % 10).cast("string")
    made = _let(_string(key, "card", F.substr(d, F.lit(1), F.length(d) - 1)), lambda body: F.concat(body, check(body)))
    return _let(d, lambda x: _luhn_sum(x, 0) % 10 == 0), _let(made, lambda x: _in_format(m, x))


def _phone(m: Column, key: str) -> tuple[Column, Column]:
    d = _digits(m)
    keep = F.length(d) - 10
    made = F.concat(F.substr(d, F.lit(1), keep), _string(key, "phone", F.substr(d, keep + 1, F.lit(10))))
    return keep >= 0, _let(made, lambda x: _in_format(m, x))


def _ip(m: Column, key: str) -> tuple[Column, Column]:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    made = _number(key, "ip", F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x), 1 << 16, 1 << 16)
    out = _let(made, lambda n: F.concat_ws(
        ".", *[F.shiftright(n, s).bitwiseAND(F.lit(255).cast("long")).cast("string") for s in (24, 16, 8, 0)]))
    return F.forall(octets, lambda x: x <= 255), out


def _late_day(key: str, day: Column, start: Column) -> Column:
    """A keyed permutation of the days of 1800 to 2199 whose day of the month is above 12.

    Such a day's rank leaves out the first twelve days of its month and of all months before."""
    months = (F.year(day) - 1800) * 12 + F.month(day)
    rank = F.datediff(day, start).cast("long") - 12 * months

    def ranked(month: Column) -> Column:
        return F.datediff(F.add_months(start, month), start) - 12 * month

    def found(n: Column) -> Column:
        # 88,497 days in 4,800 months: the month is at most one off the proportional one.
        near = F.floor(n * 4800 / 88497).cast("int")
        month = F.when(ranked(near + 1) <= n, near + 1).when(ranked(near) <= n, near).otherwise(near - 1)
        return _let(month, lambda x: F.date_add(start, (n + 12 * (x + 1)).cast("int")))
    return _let(_number(key, "late", rank, 9, 9833), found)


def _date(m: Column, key: str) -> tuple[Column, Column]:
    iso = m.contains("-")
    first, second = F.try_to_date(m, "dd/MM/yyyy"), F.try_to_date(m, "MM/dd/yyyy")
    day = F.when(iso, F.try_to_date(m, "yyyy-MM-dd")).otherwise(F.coalesce(first, second))
    start = F.to_date(F.lit("1800-01-01"))
    made = F.date_add(start, _number(key, "date", F.datediff(day, start).cast("long"), 189, 773).cast("int"))
    any_day = _let(made, lambda x: F.when(iso, F.date_format(x, "yyyy-MM-dd")).otherwise(F.date_format(x, "dd/MM/yyyy")))
    late = F.date_format(_late_day(key, second, start), "MM/dd/yyyy")
    return F.coalesce(F.year(day).between(1800, 2199), F.lit(False)), F.when(~iso & first.isNull(), late).otherwise(any_day)


def _ssn(m: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (F.substr(m, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    number = (F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1) * 9999 + serial - 1

    def written(n: Column) -> Column:
        place = F.floor(n / (99 * 9999)).cast("long")
        return F.format_string("%03d-%02d-%04d", F.when(place >= 665, place + 2).otherwise(place + 1),
                               F.floor(n / 9999).cast("long") % 99 + 1, n % 9999 + 1)

    return (area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0),
            _let(_number(key, "ssn", number, 898, 99 * 9999), written))


def _email(m: Column, key: str) -> tuple[Column, Column]:
    low = F.lower(m)
    local, domain = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    return F.lit(True), F.concat(_string(key, "email", local), F.lit("@"), domain)


_MAKE = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _replaced(m: Column, key: str) -> Column:
    """(kind, text) of a match: its pseudonym, or itself with a null kind."""
    out = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("text"))
    for kind in reversed(PATTERNS):  # the first that fits the whole match decides
        valid, made = _MAKE[kind](m, key)
        is_kind = m.rlike(f"^(?:{PATTERNS[kind]})$")
        out = F.when(is_kind & valid, F.struct(F.lit(kind).alias("kind"), made.alias("text"))).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, text with pseudonyms, and n_<kind>: how many of each kind were replaced."""
    key = key or docs.sparkSession.conf.get(KEY, None) or uuid.uuid4().hex
    # Nothing but a mail address starts elsewhere than at a digit, a sign or a parenthesis.
    whole = "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k != "email")
    whole = f"(?:{_MAIL})|(?=[0-9+(])(?:{whole})"
    rows = columns(docs, "doc_id", "text")
    rows = rows.withColumn("found", F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(whole), F.lit(0))))
    rows = rows.withColumn("pieces", F.when(F.size("found") > 0, F.split("text", whole, -1)))
    rows = rows.withColumn("made", F.when(F.size("found") > 0, F.transform("found", lambda m: _replaced(m, key))))
    text = F.array_join(F.flatten(F.transform(F.arrays_zip("pieces", "made"), lambda x: F.array(
        x["pieces"], F.coalesce(x["made"]["text"], F.lit(""))))), "")
    counts = [F.coalesce(F.size(F.filter("made", lambda x: x["kind"] == kind)), F.lit(0)).cast("long").alias(f"n_{kind}")
              for kind in PATTERNS]
    return rows.select("doc_id", F.when(F.size("found") > 0, text).otherwise(F.col("text")).alias("text"), *counts)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    return pseudonymise(read(spark, sf_dir, "documents"))
