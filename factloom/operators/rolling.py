"""Rolling totals per entity and day over trailing windows, days without activity included.

Daily totals of each entity (at most one per calendar day, whatever the number of rows) are
packed into one sparse row per entity. Tasks turn batches of entities into dense numpy blocks,
one tile of days at a time with the preceding days as a halo, and multiply each block with a
banded 0/1 matrix per window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.keys import row_key

MS_PER_DAY = 86_400_000


def day_number(utc_ms: Column) -> Column:
    return F.floor(utc_ms / F.lit(MS_PER_DAY)).cast("int")


def bands(halo: int, tile: int, windows: Sequence[int]) -> np.ndarray:
    """One column per window and day of the tile, with ones at the days that the window holds."""
    out = np.zeros((halo + tile, len(windows) * tile))
    for w, window in enumerate(windows):
        for d in range(tile):
            out[halo + d - window + 1 : halo + d + 1, w * tile + d] = 1.0
    return out


def _tiles(windows: Sequence[int], tile: int, lanes: int):
    halo = max(windows) - 1

    def block(keys: pa.Array, sizes: np.ndarray, days: np.ndarray, n: np.ndarray, s: np.ndarray, band: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(days):
            return
        row = np.repeat(np.arange(len(sizes)), sizes)
        first, last = np.full(len(sizes), np.iinfo(np.int64).max), np.full(len(sizes), np.iinfo(np.int64).min)
        np.minimum.at(first, row, days)
        np.maximum.at(last, row, days)
        for start in range(int(first.min()), int(last.max()) + 1, tile):
            here = np.flatnonzero((first < start + tile) & (last >= start))
            if not len(here):
                continue
            lane = np.full(len(sizes), -1)
            lane[here] = np.arange(len(here))
            take = (lane[row] >= 0) & (days >= start - halo) & (days < start + tile)
            at, column = lane[row[take]], days[take] - (start - halo)
            dense = np.zeros((2, len(here), halo + tile))
            dense[0, at, column] = n[take]
            dense[1, at, column] = s[take]
            totals = (dense.reshape(2 * len(here), -1) @ band).reshape(2, len(here), len(windows), tile)
            day = np.arange(start, start + tile)
            inside = (day >= first[here, None]) & (day <= last[here, None])
            who, which = np.nonzero(inside)
            arrays = [keys.take(pa.array(here[who])), pa.array(day[which].astype(np.int32)).cast(pa.date32())]
            for w in range(len(windows)):
                count, total = totals[0, who, w, which], totals[1, who, w, which]
                with np.errstate(invalid="ignore", divide="ignore"):
                    mean = total / count
                arrays += [pa.array(np.rint(count).astype(np.int64)), pa.array(total), pa.array(mean, mask=count < 0.5)]
            yield pa.RecordBatch.from_arrays(arrays, names=["entity", "day", *[f"{x}_{w}" for w in windows for x in ("n", "sum", "mean")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = bands(halo, tile, windows)
        for b in batches:
            for at in range(0, b.num_rows, lanes):
                part = b.slice(at, lanes)
                lists, keys = part.column(1), part.column(0)
                flat = lists.flatten()
                sizes = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
                days, n, s = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                yield from block(keys, sizes, days.astype(np.int64), n.astype(float), s.astype(float), band)

    return run


def rolling_totals(daily: DataFrame, entity: str, windows: Sequence[int] = (7, 30), tile: int = 64, lanes: int = 2_048) -> DataFrame:
    """``entity, day`` and ``n_W, sum_W, mean_W`` of each window W, for every day of each entity.

    ``daily`` has ``entity``, ``day`` (int, days since 1970), ``n`` and ``s``, one row per entity
    and day; a null day is left out here (a filter of it below would have Spark evaluate the
    parsing of times twice a row). Days run from an entity's first to its last one; a window
    without values has n 0, sum 0 and a null mean. ``tile`` days of ``lanes`` entities are dense at a time, so memory
    follows neither the number of entities nor the length of time.
    """
    totals = F.struct(F.col("day").cast("int"), F.col("n").cast("bigint"), F.col("s").cast("double"))
    packed = daily.groupBy(F.col(entity).alias("entity")).agg(F.collect_list(F.when(F.col("day").isNotNull(), totals)).alias("days"))
    schema = "entity string, day date, " + ", ".join(f"n_{w} bigint, sum_{w} double, mean_{w} double" for w in windows)
    return packed.mapInArrow(_tiles(tuple(windows), tile, lanes), schema).withColumnRenamed("entity", entity)


def daily_totals(events: DataFrame, entity: str, value: str, once: Sequence[str], dated: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``entity, day, n, s`` per entity and UTC day; rows alike in all columns ``once`` count once.

    ``dated`` adds the column ``utc_ms``. It runs before repeated rows are sought: these are then
    found by a key of 128 bits, and only what is totalled is shuffled beside it. Rows without
    entity are left out; those without an instant come out under a null day. ``n`` counts and
    ``s`` sums the non-null values; a day that has only null values keeps its row, with n 0.
    """
    rows = dated(events.filter(F.col(entity).isNotNull()).select(*once))
    k1, k2 = row_key(once)
    single = rows.select(k1.alias("k1"), k2.alias("k2"), F.col(entity).alias("entity"), day_number(F.col("utc_ms")).alias("day"), F.col(value).cast("double").alias("v")).distinct()
    return single.groupBy(F.col("entity").alias(entity), "day").agg(F.count("v").alias("n"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("s"))
