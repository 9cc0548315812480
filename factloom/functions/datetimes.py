"""Dates, and times that keep their offset, as column functions.

A time is a struct of the instant (``millis``) and its offset (``off_h``, ``off_m``; both null
where the offset is unknown, which prints as ``-00:00``). The struct's own order is by instant,
then offset, with unknown offsets first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_PATTERN = "yyyy-MM-dd"
_OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def parse_date(text: Column, pattern: str = DAY_PATTERN) -> Column:
    """The day, or null where the text is not one of the pattern."""
    return F.try_to_timestamp(text, F.lit(pattern)).cast("date")


def parse_date_strict(text: Column, pattern: str = DAY_PATTERN) -> Column:
    """The day; fails the job where the text is not one of the pattern. Null stays null."""
    day = parse_date(text, pattern)
    problem = F.concat(F.lit("no day of the form "), F.lit(f"{pattern}: "), text)
    return F.when(text.isNull() | day.isNotNull(), day).otherwise(F.raise_error(problem).cast("date"))


def time_of(millis: Column, off_h: Column, off_m: Column) -> Column:
    return F.struct(millis.cast("bigint").alias("millis"), off_h.cast("int").alias("off_h"), off_m.cast("int").alias("off_m"))


def _offset(text: Column) -> tuple[Column, Column, Column]:
    """Total minutes, hours and minutes of the offset at the end; all null for ``-00:00``."""
    zone = F.regexp_extract(text, _OFFSET, 1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    h = F.when(zone == "Z", 0).when(F.length(digits) == 4, digits.substr(1, 2).cast("int"))
    m = F.when(zone == "Z", 0).when(F.length(digits) == 4, digits.substr(3, 2).cast("int"))
    unknown = zone.startswith("-") & (h == 0) & (m == 0)
    return sign * (h * 60 + m), F.when(~unknown, sign * h), F.when(~unknown, sign * m)


def parse_time_format(text: Column, pattern: str) -> Column:
    """A time from a pattern that holds the zone; null where the text does not fit.

    Offsets between -00:59 and -00:01 keep their sign in ``off_m``.
    """
    if "Z" not in re.sub(r"'[^']*'", "", pattern) and "X" not in re.sub(r"'[^']*'", "", pattern):
        raise ValueError(f"the pattern {pattern} holds no zone")
    at = F.try_to_timestamp(text, F.lit(pattern))
    _, h, m = _offset(text)
    return F.when(at.isNotNull(), time_of(F.unix_millis(at), h, m))


def parse_with_millis(text: Column) -> Column:
    return parse_time_format(text, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


def parse_without_millis(text: Column) -> Column:
    return parse_time_format(text, "yyyy-MM-dd'T'HH:mm:ssXXX")


def strict(text: Column, parsed: Column) -> Column:
    """``parsed``, failing the job where a text that is not null gave none."""
    bad = F.raise_error(F.concat(F.lit("no time with a zone: "), text)).cast("struct<millis:bigint,off_h:int,off_m:int>")
    return F.when(text.isNull() | parsed.isNotNull(), parsed).otherwise(bad)


def parse_with_offset(text: Column, pattern: str, off_h: int, off_m: int) -> Column:
    """The text's wall clock under the given offset, whatever zone the text names."""
    at = F.try_to_timestamp(text, F.lit(pattern))
    has_zone = "Z" in re.sub(r"'[^']*'", "", pattern) or "X" in re.sub(r"'[^']*'", "", pattern)
    own = _offset(text)[0] if has_zone else F.lit(0)
    wall = F.unix_millis(at) + F.coalesce(own, F.lit(0)) * 60_000
    return F.when(at.isNotNull(), time_of(wall - (off_h * 60 + off_m) * 60_000, F.lit(off_h), F.lit(off_m)))


def to_utc(time: Column) -> Column:
    return F.when(time.isNotNull(), time_of(time["millis"], F.lit(0), F.lit(0)))


def rfc3339(time: Column) -> Column:
    """Wall clock in the time's own offset; ``-00:00`` where it is unknown. In a UTC session."""
    minutes = F.coalesce(time["off_h"] * 60 + time["off_m"], F.lit(0))
    wall = F.date_format(F.timestamp_millis(time["millis"] + minutes * 60_000), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    sign = F.when(time["off_h"].isNull() | (minutes < 0), "-").otherwise("+")
    zone = F.format_string("%02d:%02d", F.abs(F.coalesce(time["off_h"], F.lit(0))), F.abs(F.coalesce(time["off_m"], F.lit(0))))
    return F.when(time.isNotNull(), F.concat(wall, sign, zone))


def iso_date(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def _months(day: Column, n: Column) -> Column:
    return F.add_months(day, n)


def _forward(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Years, months and days from a to a later b, each field advancing the anchor."""
    y0 = F.year(b) - F.year(a)
    years = F.when(_months(a, y0 * 12) <= b, y0).otherwise(y0 - 1)
    anchor = _months(a, years * 12)
    m0 = (F.year(b) - F.year(anchor)) * 12 + F.month(b) - F.month(anchor)
    months = F.when(_months(anchor, m0) <= b, m0).otherwise(m0 - 1)
    return years, months, F.datediff(b, _months(anchor, months))


def _difference(a: Column, b: Column, weeks: bool) -> Column:
    turned = F.when(a > b, -1).otherwise(1)
    low, high = F.least(a, b), F.greatest(a, b)
    y, m, d = _forward(low, high)
    d = d % 7 if weeks else d
    return F.when(a.isNotNull() & b.isNotNull(), F.struct((turned * y).alias("years"), (turned * m).alias("months"), (turned * d).alias("days")))


def difference(a: Column, b: Column) -> Column:
    """``years, months, days`` from day a to day b, full weeks of the rest left out: 19 days are 5."""
    return _difference(a, b, True)


def difference_exact(a: Column, b: Column) -> Column:
    """``years, months, days`` with all days of the rest."""
    return _difference(a, b, False)
