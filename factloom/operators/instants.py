"""Normalising text times through a persisted dictionary of distinct values.

The distinct pairs of raw text and reading context (zone and date order of the source, left out
where the text alone fixes the instant) are parsed once, kept as a table in a shared folder,
and joined back to the rows. A later call parses only values the table does not hold yet.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.instants import YEAR_2024, blank_trim, context_free, with_instant
from factloom.shared import MARKED, bounded_rows, entries, fresh_path

SCHEMA = "raw string, tz string, date_order string, utc_ms bigint"
KEY = ["raw", "tz", "date_order"]
# To be raised with every change of the parser, so that kept dictionaries are not mixed up.
PARSER = 2


def reading_context(rows: DataFrame, origin: str, origins: DataFrame) -> DataFrame:
    """``rows`` with ``__tz`` and ``__order`` of their origin (null where it is unknown).

    An origin listed more than once counts as its first entry in order, so no row is lost or
    doubled; Spark broadcasts the table only while it is under the session's threshold.
    """
    known = origins.groupBy(F.col("origin").alias("__origin")).agg(F.min(F.struct("tz_name", "date_order")).alias("__x"))
    known = known.select("__origin", F.col("__x.tz_name").alias("__tz"), F.col("__x.date_order").alias("__order"))
    return rows.join(known, F.col(f"`{origin}`") == F.col("__origin"), "left").drop("__origin")


def zone_table(zone_names: DataFrame | None, limit: int = 1_000) -> dict[str, int]:
    return {} if zone_names is None else {r[0]: r[1] for r in bounded_rows(zone_names.select("abbr", "offset_min").dropna(), limit, "zone_names")}


class InstantDictionary:
    """Distinct raw times with their instants, one folder of Parquet files per batch.

    Under ``path`` every set of rules (parser, zone table, window) has a folder of its own, so a
    value read under other rules is parsed again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, zone_offsets: dict[str, int] | None = None, window=YEAR_2024):
        self.spark, self.zone_offsets, self.window = spark, zone_offsets or {}, window
        rules = hashlib.sha256(repr((PARSER, sorted(self.zone_offsets.items()), window)).encode()).hexdigest()[:16]
        self.path = f"{path or fresh_path(spark, 'instants')}/rules={rules}"

    def read(self) -> DataFrame:
        """Every value once: of several batches, two may hold the same one where they were
        written at the same time."""
        batches = entries(self.spark, self.path)
        if not batches:
            return self.spark.createDataFrame([], SCHEMA)
        d = self.spark.read.schema(SCHEMA).parquet(*batches)
        return d if len(batches) == 1 else d.groupBy(*KEY).agg(F.max("utc_ms").alias("utc_ms"))

    @staticmethod
    def keyed(rows: DataFrame, text: Column, tz: Column, date_order: Column) -> DataFrame:
        """``rows`` with the dictionary's key; rows whose text cannot be a time have a null ``raw``."""
        rows = rows.withColumn("raw", blank_trim(text))
        free = context_free(F.col("raw"))
        none = F.lit("")
        return rows.select(
            *[c for c in rows.columns if c != "raw"],
            F.when(F.col("raw").rlike(r"\d{4}"), F.col("raw")).alias("raw"),
            F.when(free, none).otherwise(F.coalesce(tz, none)).alias("key_tz"),
            F.when(free, none).otherwise(F.coalesce(date_order, none)).alias("key_order"),
        )

    def update(self, keyed: DataFrame) -> None:
        """Parse the values of ``keyed`` (raw, key_tz, key_order) that the dictionary lacks."""
        new = keyed.filter(F.col("raw").isNotNull()).select("raw", F.col("key_tz").alias("tz"), F.col("key_order").alias("date_order")).distinct()
        if entries(self.spark, self.path):
            new = new.join(self.read(), KEY, "left_anti")
        parsed = with_instant(new, "raw", "tz", "date_order", zone_offsets=self.zone_offsets, window=self.window)
        parsed.write.option(*MARKED).parquet(f"{self.path}/batch={uuid.uuid4().hex}")

    def join(self, keyed: DataFrame, *columns: str) -> DataFrame:
        """``columns`` of the keyed rows with ``utc_ms``; rows without an instant are left out.

        Both sides are sorted, so neither has to fit in memory. Values are unique in the
        dictionary, so its side of the join is even; a text that a large share of the rows holds
        skews only the other side, whose oversized partitions adaptive execution splits.
        """
        d = self.read().filter(F.col("utc_ms").isNotNull())
        rows = keyed.filter(F.col("raw").isNotNull()).select(*columns, "raw", F.col("key_tz").alias("tz"), F.col("key_order").alias("date_order"))
        return rows.join(d.hint("merge"), KEY).select(*columns, "utc_ms")


def instants(sources: dict[str, tuple[DataFrame, str, str]], origins: DataFrame, zone_names: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """``table_name, row_id, utc_ms`` for every row whose time text denotes an instant.

    ``sources`` gives by table name the rows, the column of the id and that of the text; each
    has a column ``origin``. All tables share one dictionary, persisted under ``path`` (default:
    a new folder of the shared one). Null, empty and placeholder texts, days or times of day
    that do not exist and zone-less texts of an unknown origin give no row; repeated rows stay
    repeated; an empty table gives none.
    """
    spark = origins.sparkSession
    d = InstantDictionary(spark, path, zone_table(zone_names))
    parts = [
        rows.select(F.lit(name).alias("table_name"), F.col(f"`{key}`").cast("bigint").alias("row_id"), F.col(f"`{text}`").cast("string").alias("text"), "origin") for name, (rows, key, text) in sources.items()
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    keyed = d.keyed(reading_context(rows, "origin", origins), F.col("text"), F.col("__tz"), F.col("__order"))
    d.update(keyed)
    return d.join(keyed, "table_name", "row_id")


def with_utc(rows: DataFrame, text: str, origins: DataFrame, zone_names: DataFrame | None = None, out: str = "utc_ms") -> DataFrame:
    """``rows`` with the instant of ``text`` as column ``out``, parsed in place without a shuffle."""
    read = reading_context(rows, "origin", origins)
    return with_instant(read, text, "__tz", "__order", out, zone_table(zone_names)).drop("__tz", "__order")
