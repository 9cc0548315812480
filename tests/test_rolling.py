import datetime as dt
import random
from collections import defaultdict

import pytest

from factloom.operators import rolling
from pyspark.sql import functions as F


def brute(events, windows):
    days, seen = defaultdict(list), set()
    for u, d, v, k in events:
        if u is None or (u, d, v, k) in seen:
            continue
        seen.add((u, d, v, k))
        if d is not None:
            days[u].append((d, v))
    out = {}
    for u, all_of in days.items():
        for d in range(min(x for x, _ in all_of), max(x for x, _ in all_of) + 1):
            row = []
            for w in windows:
                v = [x for e, x in all_of if d - w < e <= d and x is not None]
                row += [len(v), float(sum(v)), sum(v) / len(v) if v else None]
            out[u, d] = row
    return out


@pytest.mark.parametrize("tile,lanes", [(64, 2048), (5, 2), (31, 1)])
def test_every_day_of_every_entity(spark, tile, lanes):
    rnd = random.Random(3)
    events = [(rnd.choice(["hot"] * 6 + ["a", "b", "c", None]), rnd.choice([None] + list(range(19700, 19830))), rnd.choice([None, 1, 2, 3, 4, 5]), i) for i in range(300)]
    events += events[:40] + [("one", 19000, 4, 1), ("undated", None, 4, 1)]
    df = spark.createDataFrame(events, "user_id string, d int, rating int, k int")
    daily = rolling.daily_totals(df, "user_id", "rating", ["user_id", "d", "rating", "k"], lambda x: x.withColumn("utc_ms", F.col("d").cast("long") * 86_400_000 + 5))
    rows = rolling.rolling_totals(daily, "user_id", (7, 30), tile, lanes).collect()
    got = {(r.user_id, (r.day - dt.date(1970, 1, 1)).days): [r.n_7, r.sum_7, r.mean_7, r.n_30, r.sum_30, r.mean_30] for r in rows}
    want = brute(events, (7, 30))
    assert len(rows) == len(want) and got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == pytest.approx(w), k


def test_empty(spark):
    daily = spark.createDataFrame([], "user_id string, day int, n long, s double")
    assert rolling.rolling_totals(daily, "user_id").collect() == []
