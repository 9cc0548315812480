import datetime as dt

import pytest

from factloom.operators import sketches
from pyspark.sql import functions as F


def test_relative_error_is_independent_of_scale(spark):
    sizes = [1, 10, 100, 1_000, 5_000, 20_000, 100_000, 400_000]
    for size in sizes:
        reps = 12 if size <= 20_000 else 3
        df = spark.range(size * reps).select((F.col("id") % reps).alias("g"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("u"))
        est = [r.estimate for r in sketches.estimates(sketches.partials(df, ["g"], ["u"]), ["g"]).collect()]
        assert len(est) == reps
        errors = [abs(e / size - 1) for e in est]
        assert max(errors) <= sketches.ERROR_BOUND, (size, errors)


def test_partials_merge_to_what_one_pass_gives_and_repeats_do_not_count(spark):
    df = spark.range(20_000).select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 20).cast("int")).alias("day"), (F.col("id") % 3).cast("string").alias("origin"), (F.col("id") % 7_000).cast("string").alias("u"))
    df = df.unionByName(df)
    whole = sketches.estimates(sketches.partials(df.withColumn("one", F.lit(1)), ["one"], ["u"]), ["one"]).first().estimate
    c = sketches.DistinctCounts(spark)
    c.add(df.filter("day < '2024-01-09'"), "day", "origin", ["u"], "a").add(df.filter("day >= '2024-01-09'"), "day", "origin", ["u"], "b")
    rows = c.report("day", "origin").collect()
    assert [r.estimate for r in rows if r.grain == "year"] == [whole]
    assert abs(whole / 7_000 - 1) < sketches.ERROR_BOUND
    assert sum(r.grain == "day" for r in rows) == 20 and sum(r.grain == "origin" for r in rows) == 3 and sum(r.grain == "day_origin" for r in rows) == 60
    assert {r.day for r in rows if r.grain == "week"} == {dt.date(2024, 1, 1), dt.date(2024, 1, 8), dt.date(2024, 1, 15)}


def test_nulls_and_empty(spark):
    schema = "day date, origin string, u string"
    df = spark.createDataFrame([(None, "a", "x"), (dt.date(2024, 1, 1), None, "x"), (dt.date(2024, 1, 1), "a", None), (dt.date(2024, 1, 1), "a", "")], schema)
    rows = {(r.grain, r.day, r.origin): r.estimate for r in sketches.DistinctCounts(spark).add(df, "day", "origin", ["u"]).report("day", "origin").collect()}
    one = dt.date(2024, 1, 1)
    assert rows[("origin", None, "a")] == 2 and rows[("origin", None, None)] == 1 and rows[("day", one, None)] == 2 and rows[("day_origin", one, "a")] == 1
    assert sketches.estimates(sketches.partials(spark.createDataFrame([], schema), ["day"], ["u"]), ["day"]).collect() == []


@pytest.mark.parametrize("set_bits", [0, 1, 4096])
def test_saturated_levels_stay_finite(spark, set_bits):
    bitmap = bytes([255] * (set_bits // 8) + ([1] if set_bits % 8 else [])).ljust(4096, b"\0")
    df = spark.createDataFrame([("g", "u", 0, bytearray(bitmap))], "g string, field string, segment int, bitmap binary")
    assert sketches.estimates(df, ["g"]).first().estimate >= set_bits // 4096
