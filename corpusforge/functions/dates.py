"""Dates as people write them: a small grammar on kinds of tokens, as column operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusforge.functions.ids import missing_to_null

# The first letters of month names, English and Dutch.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "maa": 3, "mrt": 3, "apr": 4, "may": 5, "mei": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12}
_NAME = r"(?<![\p{L}])(jan(?:uary|uari)?|feb(?:ruary|ruari)?|mar(?:ch)?|maart|mrt|apr(?:il)?|may|mei|june?|juni|july?|juli|aug(?:ustus|ust)?|sep(?:tember|t)?|o[ck]t(?:ober)?|nov(?:ember)?|dec(?:ember)?)(?![\p{L}])"
_CLOCK = r"(?<!\d)([01]?\d|2[0-3])[:.]?([0-5]\d)?(?::([0-5]\d)(?:[.,]\d+)?)?\s*([ap])\.?m\b\.?|(?<![\d:])([01]?\d|2[0-3]):([0-5]\d)(?::([0-5]\d)(?:[.,]\d+)?)?(?![\d:])"
_ZONE = r"(?<=\d{2}:\d{2}|\d{2}:\d{2}:\d{2}|[.,]\d{1,9}|\d{2}:\d{2} |\d{2}:\d{2}:\d{2} )(?:[+-]\d{2}:?\d{2}(?!\d)|z\b)|\b(?:utc|gmt)(?:[+-]\d{1,2}(?::?\d{2})?)?\b"


def written_date(c: Column) -> Column:
    """The date, and the time if one is given, that a text writes; null where there is none.

    A text is lowered; of it are taken a time (12:34, 12:34:56.7, 5 pm), a zone, which doesn't move the time, a month's name, and
    numbers of one, two, four, eight or fourteen digits. Other words don't count. A year comes first or last, and of four digits
    unless it is the last of three parts or stands with a month's name (69 to 99 are of the last century). Of two parts that could
    both be the month the first is, and one over 12 is the day. A month and a year without a day mean its first. Missing years,
    parts too many, and dates that don't exist are null."""
    return _held(c, lambda x: _held(_plain(x), lambda bare: _held(F.struct(*[_clock(bare, i).alias(f"c{i}") for i in range(1, 8)]), lambda clock: _held(F.regexp_replace(bare, _CLOCK, " "), lambda rest: _read(clock, rest)))))


def _held(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c worked out once: an expression that is written at several places is worked out at each, and those of these
    places are within others."""
    return F.try_element_at(F.transform(F.array(c), use), F.lit(1))


def _plain(c: Column) -> Column:
    """The lowered text without its zone, digits alone (yyyymmdd, and with hhmmss after it) parted."""
    text = F.lower(F.trim(missing_to_null(c)))
    solid = F.regexp_replace(F.regexp_replace(text, r"(?<!\d)(\d{4})(\d{2})(\d{2})[t ]?([01]\d|2[0-3])([0-5]\d)([0-5]\d)(?!\d)", "$1-$2-$3 $4:$5:$6"), r"(?<!\d)(\d{4})(\d{2})(\d{2})(?!\d)", "$1-$2-$3")
    return F.regexp_replace(F.regexp_replace(solid, r"(?<=\d)t(?=\d)", " "), _ZONE, "")


def _clock(bare: Column, i: int) -> Column:
    return F.nullif(F.regexp_extract(bare, _CLOCK, i), F.lit(""))


def _read(clock: Column, rest: Column) -> Column:
    """The date in `rest`, with the parts of its time."""
    half = clock["c4"]
    hour = F.coalesce(clock["c1"], clock["c5"]).cast("int")
    hour = F.when(half == "p", hour % 12 + 12).when(half == "a", hour % 12).otherwise(F.coalesce(hour, F.lit(0)))
    minute, second = F.coalesce(clock["c2"], clock["c6"], F.lit("0")).cast("int"), F.coalesce(clock["c3"], clock["c7"], F.lit("0")).cast("int")
    name, numbers = F.nullif(F.regexp_extract(rest, _NAME, 1), F.lit("")), F.regexp_extract_all(rest, F.lit(r"(\d+)"), F.lit(1))
    return _held(F.struct(name.alias("name"), numbers.alias("numbers")), lambda x: _held(_day(x["name"], x["numbers"]), lambda found: _stamp(found, x["numbers"], hour, minute, second)))


def _day(name: Column, numbers: Column) -> Column:
    """struct y, m, d; null where the parts aren't a date's."""
    month = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])[F.substring(name, 1, 3)]
    n, at = F.size(numbers), lambda i: F.try_element_at(numbers, F.lit(i)).try_cast("int")
    long = lambda i: F.length(F.try_element_at(numbers, F.lit(i))) == 4
    year_of = lambda i: F.when(long(i), at(i)).when(at(i) >= 69, at(i) + 1900).otherwise(at(i) + 2000)
    day = lambda y, m, d: F.struct(y.alias("y"), m.alias("m"), d.alias("d"))
    ordered = lambda y, a, b: F.when(a > 12, day(y, b, a)).otherwise(day(y, a, b))
    one = F.lit(1)
    return (
        F.when(name.isNotNull() & (n == 1) & long(1), day(at(1), month, one))
        .when(name.isNotNull() & (n == 2) & long(1), day(at(1), month, at(2)))
        .when(name.isNotNull() & (n == 2), day(year_of(2), month, at(1)))
        .when(name.isNull() & (n == 3) & long(1), ordered(at(1), at(2), at(3)))
        .when(name.isNull() & (n == 3), ordered(year_of(3), at(1), at(2)))
        .when(name.isNull() & (n == 2) & long(1), day(at(1), at(2), one))
        .when(name.isNull() & (n == 2) & long(2), day(at(2), at(1), one))
    )


def _stamp(found: Column, numbers: Column, hour: Column, minute: Column, second: Column) -> Column:
    plain = F.forall(numbers, lambda x: F.length(x).isin(1, 2, 4))
    made = F.concat_ws("-", found["y"], found["m"], found["d"])
    whole = F.concat(made, F.lit(" "), F.concat_ws(":", hour, minute, second))
    return F.when(found.isNotNull() & plain & (found["y"] > 0), F.try_to_timestamp(whole, F.lit("y-M-d H:m:s"))).cast("timestamp_ntz")
