import glob
import shutil

import pytest
from brute_time import to_ms

from factloom.operators.instants import InstantDictionary, instants, with_utc
from pyspark.sql import functions as F

ORIGINS = [("utc", "feed", "UTC", "dmy"), ("ny", "feed", "America/New_York", "mdy"), ("howe", "job", "Australia/Lord_Howe", "dmy"), ("paris", "feed", "Europe/Paris", "dmy")]
ZONES = [("EST", -300), ("IST", 330), ("UTC", 0), ("CEST", 120)]
CASES = [
    ("2024-03-10 02:30:00", "ny", 1710055800000),  # skipped: offset before the skip
    ("2024-11-03 01:30:00", "ny", 1730611800000),  # twice: the first
    ("2024-10-06 02:15:00", "howe", 1728143100000),
    ("2024-10-27 02:30:00", "paris", 1729989000000),
    ("01/02/2024 10:00", "ny", 1704207600000),
    ("01/02/2024 10:00", "utc", 1706781600000),
    ("  2024-01-02  ", "utc", 1704153600000),
    ("2024-01-02T03:04:05.123456789Z", None, 1704164645123),
    ("2024-01-02T03:04:05-00:00", "ny", 1704164645000),
    ("2024-01-02 03:04:05 UTC+05:30", "ny", 1704144845000),
    ("2024-01-02 03:04:05 IST", "ny", 1704144845000),
    ("2024-01-02 03:04:05 America/New_York", "utc", 1704182645000),
    ("Mon, 01 Jan 2024 15:00:23 GMT", "ny", 1704121223000),
    ("January 1, 2024 12:10:20 PM", "utc", 1704111020000),
    ("January 1, 2024 12:10:20 AM", "utc", 1704067820000),
    ("01-May-2024 00:28:40", "utc", 1714523320000),
    ("20240101T151019Z", None, 1704121819000),
    ("20240101151019", "utc", 1704121819000),
    ("20240101", "utc", 1704067200000),
    ("1704121232", None, 1704121232000),
    ("1704121478.85", None, 1704121478850),
    ("1704122216651573", None, 1704122216651),
    ("1704122216651573123", None, 1704122216651),
    ("19724", None, 1704153600000),
    ("2024-02-30", "utc", None),
    ("2024-06-21 25:10:13", "utc", None),
    ("00-Jan-2024 06:47:00", "utc", None),
    ("01/01/2024 13:05 PM", "utc", None),
    ("2024-01-02 03:04:05", None, None),
    ("2024-01-02 03:04:05 Mars/Base", "utc", None),
    ("2023-01-02 03:04:05", "utc", None),
    ("2024-01-01", "paris", 1704063600000),  # the year's first midnight there is in 2023 in UTC
    ("2023-12-31", "paris", None),
    ("2024-03-01T00:00:00." + "0" * 90 + "Z", None, 1709251200000),
    ("2024-03-01T00:00:00.123" + "9" * 50_000 + "Z", None, 1709251200123),
    ("2024-03-01" + " " * 95 + "10:00:00", "utc", 1709287200000),
    (" " * 100_000 + "2024-03-01" + " " * 100_000, "utc", 1709251200000),
    ("1704067200002000000", None, 1704067200002),
    ("1704067200010000000", None, 1704067200010),
    ("1704067200010000", None, 1704067200010),
    ("19723.999999999", None, 1704153599999),
    ("x" * 100_000 + "2024 ", "utc", None),
    ("pending", "utc", None), ("\\N", "utc", None), ("", "utc", None), (None, "utc", None), ("x" * 100_000, "utc", None), ("1" * 5_000, "utc", None), ("2024-01-02 03:04 a" + "/a" * 100_000, "utc", None),
]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(ORIGINS, "origin string, kind string, tz_name string, date_order string"), spark.createDataFrame(ZONES, "abbr string, offset_min int")


def test_cases_in_place_and_through_the_dictionary(spark, tables):
    rows = spark.createDataFrame([(i, t, o, "clash") for i, (t, o, _) in enumerate(CASES)], "id long, time string, origin string, tz string")
    want = {i: ms for i, (_, _, ms) in enumerate(CASES)}
    assert {r.id: r.utc_ms for r in with_utc(rows, "time", *tables).collect()} == want
    got = instants({"t": (rows, "id", "time")}, *tables).collect()
    assert {r.row_id: r.utc_ms for r in got} == {i: ms for i, ms in want.items() if ms is not None}
    assert {r.table_name for r in got} == {"t"}


def test_dictionary_grows_by_new_values_only(spark, tables):
    d = InstantDictionary(spark, zone_offsets=dict(ZONES))
    rows = spark.createDataFrame([("2024-01-02 03:04:05", "UTC", "dmy"), ("2024-01-02 03:04:05", "UTC", "dmy"), ("1704121232", None, None)], "t string, tz string, o string")
    keyed = d.keyed(rows, F.col("t"), F.col("tz"), F.col("o"))
    d.update(keyed)
    assert d.read().count() == 2
    d.update(keyed.unionByName(d.keyed(spark.createDataFrame([("2024-01-03", "UTC", "dmy")], rows.schema), F.col("t"), F.col("tz"), F.col("o"))))
    assert d.read().count() == 3
    assert d.join(keyed, "t").count() == 3


def test_a_kept_dictionary_holds_for_its_rules_only(spark, tables, tmp_path):
    rows = spark.createDataFrame([("2024-01-02 03:04:05 XYZ", "UTC", "dmy")], "t string, tz string, o string")
    got = []
    for minutes in (60, 120, 60):
        d = InstantDictionary(spark, str(tmp_path), {"XYZ": minutes})
        keyed = d.keyed(rows, F.col("t"), F.col("tz"), F.col("o"))
        d.update(keyed)
        got.append(d.join(keyed, "t").first().utc_ms)
    assert got == [1704161045000, 1704157445000, 1704161045000]


def test_values_written_twice_at_once_join_once(spark, tables, tmp_path):
    one, two = InstantDictionary(spark, str(tmp_path), {}), InstantDictionary(spark, str(tmp_path / "other"), {})
    rows = spark.createDataFrame([("2024-01-02 03:04:05", "UTC", "dmy")] * 3, "t string, tz string, o string")
    keyed = one.keyed(rows, F.col("t"), F.col("tz"), F.col("o"))
    one.update(keyed)
    two.update(keyed)
    shutil.move(glob.glob(f"{two.path}/batch=*")[0], one.path)
    assert one.read().count() == 1 and one.join(keyed, "t").count() == 3


def test_empty_table(spark, tables):
    rows = spark.createDataFrame([], "id long, time string, origin string")
    assert instants({"t": (rows, "id", "time")}, *tables).collect() == []


def test_supplied_tables_equal_brute_force(spark, sf):
    origins, zones = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("origins", "zone_names"))
    by = {r.origin: (r.tz_name, r.date_order) for r in origins.collect()}
    names = {r.abbr: r.offset_min for r in zones.collect()}
    for t, key, text in (("ratings", "rating_id", "timestamp"), ("eavt", "fact_id", "time")):
        rows = spark.read.parquet(f"{sf}/{t}.parquet")
        got = {r.row_id: r.utc_ms for r in instants({t: (rows, key, text)}, origins, zones).collect()}
        want = {r[0]: ms for r in rows.select(key, text, "origin").collect() if (ms := to_ms(r[1], *by.get(r[2], (None, None)), names)) is not None}
        assert got == want


def test_columns_named_like_the_operators_own_stay(spark, tables):
    rows = spark.createDataFrame([(1, "2024-01-02 03:04:05", "utc", "mine", "too")], "id long, time string, origin string, tz string, date_order string")
    r = with_utc(rows, "time", *tables).first()
    assert (r.tz, r.date_order, r.utc_ms) == ("mine", "too", 1704164645000)


@pytest.mark.parametrize("zone", ["America/Los_Angeles", "Asia/Kathmandu"])
def test_the_sessions_zone_does_not_matter(spark, tables, zone):
    rows = spark.createDataFrame([(i, t, o) for i, (t, o, _) in enumerate(CASES)], "id long, time string, origin string")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = {r.id: r.utc_ms for r in with_utc(rows, "time", *tables).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == {i: ms for i, (_, _, ms) in enumerate(CASES)}
