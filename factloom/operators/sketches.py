"""Distinct counts by multiresolution bitmaps: mergeable by OR, error independent of scale.

A 64-bit hash of an identifier picks a level (level l with probability 2^-(l+1)) and one of
``LEVEL_BITS`` bits of that level's bitmap. Estan, Varghese and Fisk (2003), "Bitmap algorithms
for counting active flows on high-speed links". Eight levels share one 4,096-byte bitmap, a
segment, so Spark's own ``bitmap_construct_agg`` and ``bitmap_or_agg`` build and merge them;
higher segments exist only where sets are large enough to reach them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.shared import MARKED, entries, fresh_path, written

LEVEL_BITS = 4_096
LEVELS_PER_SEGMENT = 8
LEVELS = 32
# A level is read only while at most this share of its bits is set; beyond it, the level above
# (half the density) is the lowest one read.
MOST_SET = 0.85
# Three standard deviations of the relative error, measured in tests/test_sketches.py.
ERROR_BOUND = 0.06


def _place(identifier: Column) -> tuple[Column, Column]:
    """Segment and bit position in it."""
    h = F.xxhash64(identifier)
    slot = h.bitwiseAND(F.lit(LEVEL_BITS - 1))
    rest = F.shiftrightunsigned(h, 12).bitwiseOR(F.lit(1 << (LEVELS - 1)))
    level = F.bit_count(rest.bitwiseAND(-rest) - F.lit(1))
    return F.floor(level / LEVELS_PER_SEGMENT).cast("int"), (level % LEVELS_PER_SEGMENT) * LEVEL_BITS + slot


def partials(df: DataFrame, groups: Sequence[str], identifiers: Sequence[str]) -> DataFrame:
    """``*groups, field, segment, bitmap``: the partial result of each group and identifier column.

    Null identifiers are not counted; null groups are groups. Bits are set map-side, so a hot
    group or identifier leaves a task as one bitmap.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"`{i}`").cast("string").alias("identifier")) for i in identifiers]))
    rows = df.select(*groups, each.alias("x")).select(*groups, "x.field", "x.identifier").filter(F.col("identifier").isNotNull())
    segment, position = _place(F.col("identifier"))
    return rows.select(*groups, "field", segment.alias("segment"), position.cast("bigint").alias("position")).groupBy(*groups, "field", "segment").agg(F.bitmap_construct_agg("position").alias("bitmap"))


def merge(parts: DataFrame, groups: Sequence[Column | str]) -> DataFrame:
    """Partial results of coarser groups: the OR of finer ones."""
    cols = [F.col(g) if isinstance(g, str) else g for g in groups]
    return parts.groupBy(*cols, "field", "segment").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def estimates(parts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``*groups, field, estimate, low, high`` from merged partial results.

    The lowest level with at most ``MOST_SET`` of its bits set is the base b; the count is 2^b
    times the sum of the linear counts of all levels from b up. ``low`` and ``high`` are the
    estimate less and plus ``ERROR_BOUND``.
    """
    size = LEVEL_BITS // 8
    levels = F.array(
        *[F.struct((F.col("segment") * LEVELS_PER_SEGMENT + i).alias("level"), F.bitmap_count(F.substring(F.col("bitmap"), i * size + 1, size)).alias("set")) for i in range(LEVELS_PER_SEGMENT)]
    )
    # the bitmaps themselves are not shuffled, only the counts of their levels
    per = parts.select(*groups, "field", levels.alias("levels")).groupBy(*groups, "field").agg(F.flatten(F.collect_list("levels")).alias("levels"))
    full = F.array_max(F.transform(F.filter("levels", lambda x: x["set"] > MOST_SET * LEVEL_BITS), lambda x: x["level"]))
    top = F.array_max(F.transform(F.filter("levels", lambda x: x["set"] > 0), lambda x: x["level"]))
    base = F.least(F.coalesce(full + 1, F.lit(0)), F.coalesce(top, F.lit(0)))
    count = lambda x: -F.lit(float(LEVEL_BITS)) * F.log(F.lit(1.0) - x / F.lit(LEVEL_BITS + 0.5))
    total = F.aggregate("levels", F.lit(0.0), lambda a, x: a + F.when(x["level"] >= F.col("base"), count(x["set"])).otherwise(0.0))
    out = per.withColumn("base", base).withColumn("estimate", F.pow(F.lit(2.0), F.col("base")) * total)
    return out.select(*groups, "field", F.round("estimate").cast("bigint").alias("estimate"), F.floor(F.col("estimate") * (1 - ERROR_BOUND)).alias("low"), F.ceil(F.col("estimate") * (1 + ERROR_BOUND)).alias("high"))


class DistinctCounts:
    """Partial results by day and group kept in a shared folder, one sub-folder per batch of days."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "distinct")

    def add(self, df: DataFrame, day: str, group: str, identifiers: Sequence[str], batch: str = "0") -> DistinctCounts:
        partials(df, [day, group], identifiers).write.option(*MARKED).parquet(f"{self.path}/batch={batch}")
        return self

    def read(self) -> DataFrame:
        """The partial results of all batches whose writing was finished; at least one."""
        return self.spark.read.parquet(*entries(self.spark, self.path))

    def report(self, day: str, group: str) -> DataFrame:
        """``grain, day, group, field, estimate, low, high`` by day, group, and day with group,
        and merged by week (``day`` is its Monday) and over the year (``day`` is 1 January).

        Rows without a day count only in the grain of the group. A null group is a group. Weeks
        and the year are merged from the bitmaps of days, of which there are few.
        """
        parts = self.read().withColumnsRenamed({day: "__d", group: "__g"})
        dated = parts.filter(F.col("__d").isNotNull())
        none_day, none_group = F.lit(None).cast("date"), F.lit(None).cast("string")
        days = written(merge(dated, ["__d"]), "days")
        d, g = F.col("__d"), F.col("__g")
        # of one batch, days with group are as they were written
        single = len(entries(self.spark, self.path)) == 1
        grains = {
            "day": (days, d, none_group),
            "week": (merge(days, [F.trunc("__d", "week").alias("__d")]), d, none_group),
            "year": (merge(days, [F.trunc("__d", "year").alias("__d")]), d, none_group),
            group: (merge(parts, ["__g"]), none_day, g),
            f"day_{group}": (dated if single else merge(dated, ["__d", "__g"]), d, g),
        }
        out = None
        for grain, (rows, when, which) in grains.items():
            kept = rows.select(F.lit(grain).alias("grain"), when.alias(day), which.alias(group), "field", "segment", "bitmap")
            out = kept if out is None else out.unionByName(kept)
        return estimates(out, ["grain", day, group])
