import datetime as dt

import pytest

from factloom.functions import datetimes as d
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_dates(spark):
    ok, bad = one(spark, d.parse_date(F.lit("2000-01-20")), d.parse_date(F.lit("20-01-2000")))
    assert ok == dt.date(2000, 1, 20) and bad is None
    assert one(spark, d.iso_date(d.parse_date(F.lit("20/01/2000"), "dd/MM/yyyy")))[0] == "2000-01-20"
    with pytest.raises(PySparkException, match="no day of the form"):
        one(spark, d.parse_date_strict(F.lit("20-01-2000")))


@pytest.mark.parametrize(
    "a,b,want,days",
    [
        ("2000-01-01", "2000-01-20", (0, 0, 5), 19), ("2001-01-30", "2001-02-28", (0, 1, 0), 0), ("2000-02-29", "2001-03-28", (1, 1, 0), 0), ("2001-03-28", "2001-03-28", (0, 0, 0), 0),
        ("2001-01-20", "2000-01-01", (-1, 0, -5), -19), ("1999-12-31", "2001-01-01", (1, 0, 1), 1),
    ],
)
def test_difference(spark, a, b, want, days):
    x, y = one(spark, d.difference(F.lit(a).cast("date"), F.lit(b).cast("date")), d.difference_exact(F.lit(a).cast("date"), F.lit(b).cast("date")))
    assert tuple(x) == want and tuple(y) == (*want[:2], days)


@pytest.mark.parametrize("text", ["2000-06-06T10:00:00.000+00:00", "2000-06-06T20:00:00.000+10:00", "2000-06-06T20:00:00.000-00:00", "1999-12-31T23:59:59.999-03:30"])
def test_times_keep_their_offset(spark, text):
    t = d.parse_with_millis(F.lit(text))
    assert one(spark, d.rfc3339(t))[0] == text
    utc = one(spark, d.rfc3339(d.to_utc(t)))[0]
    assert utc.endswith("+00:00") and dt.datetime.fromisoformat(utc) == dt.datetime.fromisoformat(text)


def test_time_order_is_by_instant_then_offset(spark):
    a, b, c = (d.parse_with_millis(F.lit(x)) for x in ("2000-06-06T10:00:00.000+00:00", "2000-06-06T20:00:00.000+10:00", "2000-06-06T20:00:00.000-00:00"))
    assert tuple(one(spark, a < b, a < c, b < c)) == (True, True, True)


def test_formats_and_offsets(spark):
    assert one(spark, d.rfc3339(d.parse_without_millis(F.lit("2000-06-06T10:00:00+02:00"))))[0] == "2000-06-06T10:00:00.000+02:00"
    assert one(spark, d.parse_with_millis(F.lit("06-06-2000")))[0] is None
    with pytest.raises(ValueError):
        d.parse_time_format(F.lit("x"), "yyyy-MM-dd'Z'")
    replaced = d.parse_with_offset(F.lit("2000-06-06T10:00:00+02:00"), "yyyy-MM-dd'T'HH:mm:ssXXX", -3, -30)
    assert one(spark, d.rfc3339(replaced))[0] == "2000-06-06T10:00:00.000-03:30"
    with pytest.raises(PySparkException, match="no time with a zone"):
        one(spark, d.strict(F.lit("x"), d.parse_with_millis(F.lit("x"))))
