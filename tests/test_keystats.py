import math
import random
from collections import defaultdict

import pytest

from factloom.operators import keystats

SCHEMA = "rating_id long, user_id string, movie_id string, rating int"


def brute(rows):
    groups = defaultdict(list)
    for _, u, m, r in rows:
        for f, k in (("user_id", u), ("movie_id", m)):
            if k is not None:
                groups[f, k].append(r)
    out = {}
    for key, all_of in groups.items():
        v = [x for x in all_of if x is not None]
        mean = sum(v) / len(v) if v else None
        sd = math.sqrt(sum((x - mean) ** 2 for x in v) / len(v)) if v else None
        out[key] = (len(all_of), len(v), mean, sd)
    return out


def test_stats_equal_brute_force_with_hot_keys_nulls_and_repeats(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["hot"] * 20 + ["a", "b", None, ""]), str(rnd.randrange(400)) if rnd.random() < 0.6 else "7", rnd.choice([1, 2, 3, 4, 5, None])) for i in range(5000)]
    rows += rows[:200] + [(9, "only-null", "x", None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    for how in ({}, {"chunk": 64, "most": 10, "blocks": 3}):
        got = {(r.field, r.key_value): r for r in keystats.key_stats(df, ["movie_id", "user_id"], "rating", **how).collect()}
        assert got.keys() == want.keys()
        for k, (n, v, mean, sd) in want.items():
            r = got[k]
            assert (r.n_rows, r.n_values) == (n, v)
            assert (r.mean is None and mean is None) or r.mean == pytest.approx(mean)
            assert (r.stddev is None and sd is None) or r.stddev == pytest.approx(sd, abs=1e-9)


def test_heavy_keys_count_all_rows_and_include_the_bound(spark):
    rows = [(i, "h" if i < 25 else None, f"m{i}", 3) for i in range(1000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(r.field, r.key_value, r.n_rows) for r in keystats.heavy_keys(df, ["movie_id", "user_id"], "rating").collect()] == [("user_id", "h", 25)]
    assert keystats.heavy_keys(df.limit(0), ["movie_id", "user_id"], "rating").collect() == []


def test_extra_and_clashing_columns_do_not_matter(spark):
    df = spark.createDataFrame([("a", "m", 4, "x", 1), ("a", None, 2, "y", 2)], "user_id string, movie_id string, rating int, field string, n long")
    got = {(r.field, r.key_value): (r.n_rows, r.mean) for r in keystats.key_stats(df, ["movie_id", "user_id"], "rating").collect()}
    assert got == {("movie_id", "m"): (1, 4.0), ("user_id", "a"): (2, 3.0)}


def test_deviation_of_large_values(spark):
    # (neighbouring doubles at 1e9 are 1.2e-7 apart)
    df = spark.createDataFrame([(k, "m", 1e9 + v) for v in (0, 1, 2) for k in ("a", "b")] * 3, "user_id string, movie_id string, rating double").repartition(4)
    for how in ({}, {"chunk": 2, "most": 1}):
        got = {(r.field, r.key_value): r.stddev for r in keystats.key_stats(df, ["movie_id", "user_id"], "rating", **how).collect()}
        assert got == {k: pytest.approx(math.sqrt(2 / 3), rel=1e-7) for k in (("movie_id", "m"), ("user_id", "a"), ("user_id", "b"))}


def test_shares_below_a_millionth(spark):
    df = spark.range(1000).selectExpr("'u' AS user_id", "CAST(id AS STRING) AS movie_id", "1 AS rating")
    assert keystats.heavy_keys(df, ["movie_id", "user_id"], "rating", share=1e-7).count() == 1001
    assert keystats.heavy_keys(df, ["user_id", "movie_id"], "rating", share=0.0010001).count() == 1


def test_heavy_keys_read_the_table_once(spark):
    df = spark.range(1000).selectExpr("'u' AS user_id", "CAST(id AS STRING) AS movie_id", "1 AS rating")
    found = keystats.heavy_keys(df, ["movie_id", "user_id"], "rating")
    found.collect()
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
