import random
from collections import defaultdict

from factloom.operators import eventfeatures
from pyspark.sql import functions as F

SCHEMA = "user_id string, origin string, rating int, ts int, extra string"
ONCE = ["user_id", "origin", "rating", "ts"]


def dated(df):
    return df.withColumn("utc_ms", F.col("ts").cast("long") * 86_400_000)


def test_features_equal_brute_force(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["hot"] * 9 + ["a", "b", None]), rnd.choice(["web", "tv", None]), rnd.choice([1, 2, None]), rnd.choice([None, 100, 105, 110, 119]), str(i)) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    types = eventfeatures.event_types(df, ["origin", "rating"])
    assert len(types) == 9 and types[0] == (None, None)
    want = defaultdict(lambda: [0, None, 0])
    for u, o, r, t in {x[:4] for x in rows}:
        if u is not None:
            w = want[u, (o, r)]
            w[0] += 1
            w[1] = w[1] if t is None else min(120 - t, w[1] if w[1] is not None else 10**9)
            w[2] += r or 0
    got = eventfeatures.event_features(df, "user_id", ["origin", "rating"], "rating", ONCE, dated, 120, salts=3, lanes=2).collect()
    assert {r.user_id for r in got} == {"hot", "a", "b"}
    for r in got:
        for i, t in enumerate(types):
            assert [r.n[i], r.days_since_last[i], r.total[i]] == want[r.user_id, t], (r.user_id, t)


def test_wide_form_and_empty(spark):
    df = spark.createDataFrame([("a", "web", 1, 100, ""), ("a", "tv", None, None, "")], SCHEMA)
    types = eventfeatures.event_types(df, ["origin", "rating"])
    wide = eventfeatures.widened(eventfeatures.event_features(df, "user_id", ["origin", "rating"], "rating", ONCE, dated, 120), "user_id", types).first()
    assert wide["n__web__1"] == 1 and wide["days_since_last__web__1"] == 20 and wide["n__tv__none"] == 1 and wide["days_since_last__tv__none"] is None
    assert eventfeatures.event_features(df.limit(0), "user_id", ["origin", "rating"], "rating", ONCE, dated, 120).collect() == []


def test_columns_named_like_the_operators_own(spark):
    df = spark.createDataFrame([("a", "x", 1, 100), ("a", "x", 1, 100), ("a", "y", 2, 101)], "entity string, type string, salt int, ts int")
    r = eventfeatures.event_features(df, "entity", ["type"], "salt", ["entity", "type", "salt", "ts"], dated, 120).first()
    assert (r.entity, r.n, r.days_since_last, r.total) == ("a", [1, 1], [20, 19], [1, 2])
