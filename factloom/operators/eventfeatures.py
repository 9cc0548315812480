"""One row per entity with count, recency and total for each of hundreds of event types.

Two-stage salted aggregation: a group of one entity and type is spread over salts taken from
the key of the row, so no task gets all of a heavy group; the partial statistics (one per
entity, type and salt) are merged per entity and scattered into dense arrays over the complete
list of types.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.keys import row_key
from factloom.operators.rolling import day_number
from factloom.shared import bounded_rows


def event_types(events: DataFrame, by: Sequence[str], most: int = 10_000) -> list[tuple]:
    """Every combination of the columns ``by``, nulls first; raises beyond ``most`` of them."""
    rows = bounded_rows(events.select(*by).distinct(), most, "event types")
    return sorted((tuple(r) for r in rows), key=lambda t: [(x is not None, x if x is not None else 0) for x in t])


def _expand(n_types: int, as_of_day: int, lanes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, lanes):
                b = whole.slice(at, lanes)
                lists = b.column(1)
                flat, rows = lists.flatten(), b.num_rows
                which, n, last, total = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                slot = np.repeat(np.arange(rows), np.diff(lists.offsets.to_numpy())) * n_types + which
                count, latest, sums = np.zeros(rows * n_types, np.int64), np.full(rows * n_types, -(2**31), np.int64), np.zeros(rows * n_types, np.int64)
                np.add.at(count, slot, n)
                np.maximum.at(latest, slot, np.where(np.isnan(last.astype(float)), -(2**31), last).astype(np.int64))
                np.add.at(sums, slot, total)
                since = pa.array((as_of_day - latest).astype(np.int32), mask=latest == -(2**31))
                offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * n_types)
                cut = lambda a: pa.ListArray.from_arrays(offsets, a)
                yield pa.RecordBatch.from_arrays([b.column(0), cut(pa.array(count)), cut(since), cut(pa.array(sums))], names=["entity", "n", "days_since_last", "total"])

    return run


def event_features(
    events: DataFrame, entity: str, by: Sequence[str], value: str, once: Sequence[str], dated: Callable[[DataFrame], DataFrame], as_of_day: int, types: Sequence[tuple] | None = None, salts: int = 8, lanes: int = 512
) -> DataFrame:
    """``entity, n, days_since_last, total``: arrays with one element per type of ``event_types``.

    ``by`` are the columns whose combination is the type, ``value`` (integral) is totalled, rows
    alike in all columns ``once`` count once. ``dated`` adds the column ``utc_ms``. ``days_since_last`` counts from the UTC day of the
    last event to ``as_of_day`` (days since 1970).

    Defined results: a null in ``by`` is a value of its own; rows without entity are left out; a
    type an entity has no events of has n 0, total 0 and a null recency; an event without a
    readable time counts in n and total but not in the recency; null values add 0.
    """
    spark = events.sparkSession
    types = event_types(events, by) if types is None else list(types)
    fields = ", ".join(f"__t{i} {dict(events.dtypes)[c]}" for i, c in enumerate(by))
    lookup = spark.createDataFrame([(*t, i) for i, t in enumerate(types)], f"{fields}, __type int") if types else spark.createDataFrame([], f"{fields}, __type int")
    rows = dated(events.filter(F.col(entity).isNotNull()).select(*once))
    match = None
    for i, c in enumerate(by):
        same = F.col(c).eqNullSafe(F.col(f"__t{i}"))
        match = same if match is None else match & same
    # repeated rows are found by a key of 128 bits; only what is totalled is shuffled beside it
    k1, k2 = row_key(once)
    typed = rows.join(lookup, match).select(k1.alias("k1"), k2.alias("k2"), F.col(entity).alias("entity"), F.col("__type").alias("type"), day_number(F.col("utc_ms")).alias("day"), F.col(value).cast("bigint").alias("value"))
    single = typed.distinct().withColumn("salt", F.pmod("k1", F.lit(salts)))
    stage1 = single.groupBy("entity", "type", "salt").agg(F.count(F.lit(1)).alias("n"), F.max("day").alias("last"), F.coalesce(F.sum("value"), F.lit(0)).alias("total"))
    packed = stage1.groupBy("entity").agg(F.collect_list(F.struct("type", "n", "last", "total")).alias("x"))
    out = packed.mapInArrow(_expand(len(types), as_of_day, lanes), "entity string, n array<bigint>, days_since_last array<int>, total array<bigint>")
    return out.withColumnRenamed("entity", entity)


def widened(features: DataFrame, entity: str, types: Sequence[tuple]) -> DataFrame:
    """The arrays as one column per type and statistic, named ``n__TYPE`` and so on."""
    label = lambda t: "__".join("none" if x is None else str(x) for x in t)
    return features.select(entity, *[F.col(s)[i].alias(f"{s}__{label(t)}") for i, t in enumerate(types) for s in ("n", "days_since_last", "total")])


__all__ = ["event_features", "event_types", "widened"]
