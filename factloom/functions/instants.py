"""One UTC instant from text in mixed formats, precisions and zones, as JVM column expressions.

A text is matched once against one pattern with alternatives for the date's layout; the pieces
are joined by ``|`` and split again, so that one regular-expression pass per text is enough.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# English month names and weekday names, as they occur in the texts.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

_MON = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS) + "|sept)"
_DOW = "(?:(?:" + "|".join(f"{d[:3]}(?:{d[3:]})?" for d in WEEKDAYS) + r")\.?,? +)?"
_DATE = "|".join(
    (
        r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})",
        r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})",
        rf"{_DOW}(\d{{1,2}})(?:st|nd|rd|th)?[- ]({_MON})\.?,?[- ](\d{{4}})",
        rf"{_DOW}({_MON})\.? +(\d{{1,2}})(?:st|nd|rd|th)?,? +(\d{{4}})",
        r"(\d{4})(\d{2})(\d{2})",
    )
)
_CLOCK = r"(?:(?:t|,? +|(?<=^\d{8})))(\d{1,2}):?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?(?: ?([ap])\.?m\.?(?![a-z]))?"
_ZONE = r" *(?:\(?(z|(?:utc|gmt)? ?[+-]\d{1,2}(?::?\d{2})?|[a-z][a-z_]+(?:/[a-z0-9_+-]+){0,2})\)?)?"
PATTERN = rf"(?i)^(?:{_DATE})(?:{_CLOCK})?{_ZONE}$"
_PIECES = "$1$6$9$12$13|$2$8$10$14|$3$7$11$15|$4|$5|$16|$17|$18|$19|$20|$21|"

COUNT = r"^\d{5,19}(?:[.,]\d+)?$"
ZONED = r"(?i)(?:\d *z|[+-]\d{1,2}(?::?\d{2})?|[a-z]{2}\)?|/[a-z0-9_+-]+)$"
MERIDIEM = r"(?i)\d ?[ap]\.?m\.?$"

# Milliseconds of one unit, as numerator and denominator; the order is of no importance: at
# most one unit puts a count into a window of a year.
UNITS = ((86_400_000, 1), (3_600_000, 1), (60_000, 1), (1_000, 1), (1, 1), (1, 1_000), (1, 1_000_000))
YEAR_2024 = (1_704_067_200_000, 1_735_689_600_000)


@cache
def known_zones() -> str:
    """The region names of the JVM's zone rules (about 600, fixed by the Java release), as SQL literals."""
    jvm = SparkSession.active().sparkContext._jvm
    return ", ".join(f"'{z}'" for z in sorted(jvm.java.lang.String.join(" ", jvm.java.time.ZoneId.getAvailableZoneIds()).split()))


def blank_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\v\f\r"))


def context_free(text: Column) -> Column:
    """True where the (trimmed) text alone fixes the instant: a zone is in it or it is a count."""
    count = text.rlike(COUNT) & ~text.rlike(r"^\d{8}$|^\d{12}$|^\d{14}$")
    return F.coalesce(count | (text.rlike(ZONED) & ~text.rlike(MERIDIEM) & text.rlike(r":|\dT?\d{6}")), F.lit(False))


def _apart(c: Column) -> Column:
    """``c``, in a form that keeps its projection out of whole-stage code generation.

    Fused into one method, these projections pass the size up to which the JVM compiles a
    method and run three times slower; by itself, a projection is generated in small methods.
    """
    return F.get(F.transform(F.array(c), lambda x: x), F.lit(0))


def _count_ms(whole: Column, nanos: Column, window: tuple[int, int]) -> Column:
    """A count of any unit in ms, in 64-bit integers throughout."""
    out = None
    for per, parts in UNITS:
        low, high = window[0] * parts // per, -(-window[1] * parts // per)
        if parts > 1:
            ms = F.call_function("div", whole, F.lit(parts))
        else:
            ms = whole * F.lit(per) + F.call_function("div", nanos * F.lit(per), F.lit(1_000_000_000))
        hit = (whole >= low) & (whole < high)
        out = F.when(hit, ms.cast("bigint")) if out is None else out.when(hit, ms.cast("bigint"))
    return out


def _exists(y: Column, m: Column, d: Column) -> Column:
    """Whether the Gregorian calendar has the day."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    days = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return m.between(1, 12) & (d >= 1) & (d <= days)


def _day_number(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01, in integers: years are counted from March, so that the leap day
    comes last, and months of such a year begin 153 days apart every five."""
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    year = y - F.when(m <= 2, 1).otherwise(0)
    month = F.when(m <= 2, m + 9).otherwise(m - 3)
    return year * 365 + div(year, 4) - div(year, 100) + div(year, 400) + div(month * 153 + 2, 5) + d - 719_469


def with_instant(
    df: DataFrame,
    text: str,
    tz: str,
    date_order: str,
    out: str = "utc_ms",
    zone_offsets: dict[str, int] | None = None,
    window: tuple[int, int] | None = YEAR_2024,
) -> DataFrame:
    """``df`` with the column ``out``: milliseconds since 1970-01-01 UTC, finer digits dropped.

    ``text`` names the column of raw text, ``tz`` that of the wall clock's IANA zone, and
    ``date_order`` that of ``dmy`` or ``mdy`` (used only for numeric day and month before the
    year). ``zone_offsets`` gives minutes east of UTC by abbreviation. ``window`` bounds the
    instants (first and last, exclusive, in ms): a count of time units takes the unit that puts
    it there, and of a wall clock either the instant or the time as written lies there (the
    first midnight of a year comes earlier in UTC east of it).

    Defined results: null, empty, placeholder text, an unknown zone, a day or time of day that
    does not exist, a wall clock without a known zone, and an instant outside the window give
    null. A repeated wall-clock time is its first occurrence, a skipped one is read with the
    offset in force before the skip.
    """
    p = "__" + out
    trimmed, pieces = f"{p}_t", f"{p}_p"
    df = df.withColumn(trimmed, blank_trim(F.col(text)))
    point = F.instr(F.replace(F.col(trimmed), F.lit(","), F.lit(".")), ".")
    number = F.struct(
        F.when(point > 0, F.col(trimmed).substr(F.lit(1), point - 1)).otherwise(F.col(trimmed)).cast("decimal(20,0)").try_cast("bigint").alias("whole"),
        F.when(point > 0, F.rpad(F.col(trimmed).substr(point + 1, F.lit(9)), 9, "0").cast("bigint")).otherwise(0).alias("nanos"),
    )
    df = df.withColumn(f"{p}_c", F.when(F.col(trimmed).rlike(COUNT), number))
    df = df.withColumn(pieces, F.when(F.col(trimmed).rlike(r"\d"), F.split(_apart(F.regexp_replace(F.col(trimmed), PATTERN, _PIECES)), r"\|")))
    at = lambda i: F.try_element_at(F.col(pieces), F.lit(i + 1))
    # only digits are cast: a failing try_cast is an exception raised and caught
    num = lambda c: F.when(F.length(c).between(1, 9), c).cast("int")
    # One struct per step, so that no later step repeats an earlier one's expressions.
    df = df.withColumn(
        f"{p}_n",
        F.when(
            F.size(F.col(pieces)) == 12,
            F.struct(
                *[num(at(i)).alias(x) for i, x in ((0, "year"), (2, "day"), (3, "first"), (4, "second"))],
                num(F.when(F.length(at(1)) <= 2, at(1))).alias("month"),
                F.lower(F.substring(at(1), 1, 3)).alias("name"),
                *[num(F.concat(F.lit("0"), at(i))).alias(x) for i, x in ((5, "h"), (6, "mi"), (7, "s"))],
                num(F.rpad(F.substring(at(8), 1, 3), 3, "0")).alias("milli"),
                _apart(F.lower(at(9))).alias("half"),
                at(10).alias("zone"),
                F.when(at(10).rlike("[+-]"), F.regexp_replace(F.upper(at(10)), r"^(?:UTC|GMT) ?(?=[+-])", "")).otherwise(F.upper(at(10))).alias("bare"),
                F.when(at(10).rlike(r"[+-]\d"), num(F.regexp_replace(at(10), "[^0-9]", ""))).alias("hhmm"),
            ),
        ),
    )
    n = lambda x: F.col(f"{p}_n.{x}")
    by_name = (F.instr(F.lit("".join(m[:3] for m in MONTHS)), n("name")) + 2) / 3
    day_first = F.col(date_order) == "dmy"
    known_order = F.col(date_order).isin("dmy", "mdy")
    numeric_first = n("first").isNotNull()
    month = F.when(numeric_first, F.when(known_order, F.when(day_first, n("second")).otherwise(n("first")))).otherwise(F.coalesce(n("month"), by_name.cast("int")))
    day = F.when(numeric_first, F.when(day_first, n("first")).otherwise(n("second"))).otherwise(n("day"))
    hour = F.when(n("half") == "", n("h")).when(n("h").between(1, 12), n("h") % 12 + F.when(n("half") == "p", 12).otherwise(0))
    # (a struct keeps the parts from being repeated in the arithmetic)
    df = df.withColumn(f"{p}_d", F.when(n("zone").isNotNull(), F.struct(n("year").alias("y"), month.cast("int").alias("m"), day.cast("int").alias("d"), hour.cast("int").alias("h"))))
    part = lambda x: F.col(f"{p}_d.{x}")
    wall = F.when(_exists(part("y"), part("m"), part("d")) & (part("h") <= 23) & (n("mi") <= 59) & (n("s") <= 59), _day_number(part("y"), part("m"), part("d")) * 86_400 + part("h") * 3_600 + n("mi") * 60 + n("s"))
    hhmm = F.when(n("hhmm") < 100, n("hhmm") * 100).otherwise(n("hhmm"))
    shift = F.when((hhmm <= 1800) & (hhmm % 100 <= 59), (F.floor(hhmm / 100) * 60 + hhmm % 100) * F.when(n("bare").startswith("-"), -1).otherwise(1))
    table = {"Z": 0} | {k.upper(): int(v) for k, v in (zone_offsets or {}).items()}
    listed = F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]), n("bare"))
    signed = F.substring(n("bare"), 1, 1).isin("+", "-")
    # (not a bare struct: Spark would take that apart and repeat its parts wherever they are used)
    df = df.withColumn(
        f"{p}_w",
        F.when(
            n("zone").isNotNull(),
            F.struct(
                wall.alias("wall"),
                F.when(signed, shift.cast("int")).when(n("bare") != "", listed).alias("minutes"),
                _apart(F.when(n("zone") == "", F.col(tz)).when(~signed, n("zone"))).alias("region"),
            ),
        ),
    )
    w = lambda x: F.col(f"{p}_w.{x}")
    region = F.when(F.expr(f"`{p}_w`.region IN ({known_zones()})"), w("region"))
    clock = F.coalesce((w("wall") - w("minutes") * 60) * 1_000, F.unix_millis(F.to_utc_timestamp(F.timestamp_seconds(w("wall")), region)))
    count = F.when(F.col(f"{p}_c").isNotNull(), _count_ms(F.col(f"{p}_c.whole"), F.col(f"{p}_c.nanos"), window or YEAR_2024))
    df = df.withColumn(out, F.coalesce(count, _apart(clock + n("milli"))))
    if window:
        inside = lambda c: c.between(window[0], window[1] - 1)
        df = df.withColumn(out, F.when(inside(F.col(out)) | F.coalesce(inside(w("wall") * 1_000), F.lit(False)), F.col(out)))
    return df.drop(trimmed, pieces, f"{p}_c", f"{p}_n", f"{p}_d", f"{p}_w")
