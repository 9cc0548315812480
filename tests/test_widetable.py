import datetime as dt
import math
from decimal import Decimal

import pytest

from factloom.operators import widetable

META = [("AGE", "integral"), ("CREDIT", "decimal"), ("SCORE", "floatingpoint"), ("JOINED", "date"), ("SEEN", "time"), ("OK", "bool"), ("NOTE", "str"), ("entity", "str")]
FACTS = "entity string, attribute string, value string, utc_ms long, fact_id long, typed string"
FITS = {
    "integral": (["0", "-0", "+7", "9223372036854775807", " 5 "], ["", "9223372036854775808", "8e8", "8.0", "٣", "1 2", "twelve"]),
    "decimal": (["1", "-1.50", "6E-5", "5.1E+5", " 0.00 ", "1E30"], ["", "NaN", ".5", "5.", "1e5", "4E", "18,50", "1/3"]),
    "floatingpoint": (["1", "1.5", "NaN", "Infinity", "-Infinity", "4.0E-5", "1E400"], ["", "nan", "inf", "-NaN", "..2", "~3", "3 %"]),
    "date": (["2024-02-29", "9999-12-31", " 1986-12-15"], ["2023-02-29", "2024-3-4", "20240314", "0000-00-00", "yesterday", ""]),
    "time": (["2024-05-29T17:34:56.781-05:00", "2024-02-29T00:00:00.000+05:30"], ["2024-02-30T10:00:00.000+04:00", "2024-05-07T24:26:00.000+00:00", "2024-05-07T10:26:00+00:00", "2024-05-07T10:26:00.000Z", "2024-05-07T10:61:00.000+00:00", ""]),
    "bool": (["true", "FALSE", " True"], ["", "1", "yes", "tru"]),
    "str": (["", "anything", " "], []),
}


@pytest.fixture(scope="module")
def meta(spark):
    return spark.createDataFrame(META, "attribute string, value_type string")


def test_misfits(spark, meta):
    names = {t: a for a, t in reversed(META)}
    rows, want = [], set()
    for t, (good, bad) in FITS.items():
        for i, v in enumerate([*good, None, "\\N"]):
            rows.append((f"{t}-good-{i}", f" {names[t].lower()} ", v, 1, i, "x"))
        for i, v in enumerate(bad):
            rows.append((f"{t}-bad-{i}", names[t], v, 1, i, "x"))
            want.add((f"{t}-bad-{i}", names[t]))
    rows.append(("e", "undeclared", "x", 1, 1, "x"))
    got = widetable.misfits(spark.createDataFrame(rows + rows[:3], FACTS), meta).collect()
    assert {(r.entity, r.attribute) for r in got} == want and len(got) == len(want)


def test_latest_fitting_value_in_its_type(spark, meta):
    facts = [
        ("a", "AGE", "1", 10, 1, ""), ("a", "age", "2", 20, 2, ""), ("a", "Age ", "x", 30, 3, ""), ("a", "CREDIT", "-1.50", None, 4, ""), ("a", "SCORE", "NaN", 5, 5, ""),
        ("a", "JOINED", "2024-02-29", 5, 6, ""), ("a", "SEEN", "2024-05-29T17:34:56.781-05:00", 5, 7, ""), ("a", "OK", "TRUE", 5, 8, ""), ("a", "NOTE", " n ", 5, 9, ""),
        ("a", "ENTITY", "clash", 5, 10, ""), ("b", "AGE", "5", 10, 1, ""), ("b", "AGE", "6", 10, 2, ""), ("b", "NOTE", "y", 1, 1, ""), ("b", "NOTE", "\\N", 2, 2, ""), ("c", "nope", "1", 1, 1, ""),
        ("d", "CREDIT", "1E30", 1, 1, ""),
    ]
    df = widetable.wide_table(spark.createDataFrame(facts + facts[:2], FACTS).repartition(3), meta)
    assert dict(df.dtypes) == {"entity": "string", "AGE": "bigint", "CREDIT": "decimal(38,18)", "SCORE": "double", "JOINED": "date", "SEEN": "timestamp", "OK": "boolean", "NOTE": "string", "attribute_entity": "string"}
    rows = {r.entity: r for r in df.collect()}
    a, b = rows["a"], rows["b"]
    assert rows.keys() == {"a", "b", "c", "d"}
    assert (a.AGE, a.CREDIT, a.JOINED, a.OK, a.NOTE, a.attribute_entity) == (2, Decimal("-1.5"), dt.date(2024, 2, 29), True, "n", "clash") and math.isnan(a.SCORE)
    assert a.SEEN.astimezone(dt.timezone.utc).replace(tzinfo=None) == dt.datetime(2024, 5, 29, 22, 34, 56, 781000)
    assert (b.AGE, b.NOTE) == (6, None)
    assert all(rows["c"][x] is None for x in df.columns[1:]) and rows["d"].CREDIT is None


def test_batches_split_inside_an_entity(spark, meta):
    facts = [(f"e{i // 3}", ["AGE", "NOTE", "CREDIT"][i % 3], str(i), i, i, "") for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = widetable.wide_table(spark.createDataFrame(facts, FACTS), meta).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.entity: (r.AGE, r.NOTE, r.CREDIT) for r in rows} == {f"e{k}": (3 * k, str(3 * k + 1), Decimal(3 * k + 2)) for k in range(100)}


def test_empty(spark, meta):
    assert widetable.wide_table(spark.createDataFrame([], FACTS), meta).collect() == []
    assert widetable.misfits(spark.createDataFrame([], FACTS), meta).collect() == []


def test_attributes_declared_twice_or_null(spark):
    meta = spark.createDataFrame([("AGE", "integral"), ("age ", "str"), (None, "str"), ("X", None), ("ODD", "blob")], "attribute string, value_type string")
    df = widetable.wide_table(spark.createDataFrame([("a", "Age", "5", 1, 1, ""), (None, "AGE", "5", 1, 1, ""), ("a", None, "5", 1, 1, ""), ("a", "x", "5", 1, 1, "")], FACTS), meta)
    assert [tuple(r) for r in df.collect()] == [("a", 5)] and df.columns == ["entity", "AGE"]


def test_decimals_that_do_not_fit_keep_their_text(spark, meta):
    texts = {"a": "1E30", "b": "0.1234567890123456789", "c": "12345678901234567890", "d": "123456789012345678901", "e": "1E-999999999", "f": "1E99999999999", "g": "5.10E+2", "h": "-0.123456789012345678000"}
    df = widetable.wide_table(spark.createDataFrame([(e, "CREDIT", v, 1, 1, "") for e, v in texts.items()], FACTS), meta, beyond="texts")
    rows = {r.entity: (r.CREDIT, r.texts) for r in df.collect()}
    lost = {"a", "b", "d", "e", "f"}
    assert {e: t for e, (_, t) in rows.items()} == {e: {"CREDIT": v} if e in lost else {} for e, v in texts.items()}
    assert {e: c for e, (c, _) in rows.items() if c is not None} == {"c": Decimal("12345678901234567890"), "g": Decimal(510), "h": Decimal("-0.123456789012345678")}


def test_misfits_come_from_the_builders_beside_the_cells(spark, meta):
    facts = [("hot", "AGE", f"x{i}", i, i, "") for i in range(2_000)] + [("hot", "AGE", "7", 5, 5, ""), ("hot", "OK", "maybe", 1, 1, ""), ("b", "AGE", "8", 1, 1, ""), (None, "AGE", "x", 1, 1, "")]
    df = spark.createDataFrame(facts, FACTS).repartition(4)
    built, names = widetable.typed_rows(df, meta)
    rows = {r.entity: r for r in built.collect()}
    assert rows.keys() == {"hot", "b"} and rows["hot"][f"a{names.index('AGE')}"] == 7 and rows["b"].misfits == []
    assert [tuple(m) for m in rows["hot"].misfits] == [("AGE", 2_000), ("OK", 1)]
    found = widetable.misfits(df, meta)
    assert {tuple(r) for r in found.collect()} == {("hot", "AGE", 2_000), ("hot", "OK", 1)}
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
