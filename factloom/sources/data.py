"""Concrete data sets: text, Parquet, any DataFrame, and views, filters and distincts of them."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.record import Schema, session
from factloom.stats import Stats

log = logging.getLogger("factloom.sources")


class DataSource:
    """Something that loads lazily as a DataFrame."""

    def load(self, stats: Stats | None = None) -> DataFrame:
        raise NotImplementedError

    def where(self, condition: Callable[[DataFrame], Column]) -> DataSource:
        """Rows before any join."""
        return _Derived(self, lambda df: df.filter(condition(df)), "where")

    def distinct(self) -> DataSource:
        return _Derived(self, lambda df: df.distinct(), "distinct")

    def distinct_by(self, key: Callable[[DataFrame], Any], deterministic: bool = False) -> DataSource:
        """One row per key: any, or with ``deterministic`` the first in order of all columns."""

        def one(df: DataFrame) -> DataFrame:
            keys = key(df)
            keys = list(keys) if isinstance(keys, (tuple, list)) else [keys]
            names = [f"__k{i}" for i in range(len(keys))]
            keyed = df.withColumns(dict(zip(names, keys, strict=True)))
            if not deterministic:
                return keyed.dropDuplicates(names).drop(*names)
            # min over the row's columns in order: partial aggregation before the shuffle
            row = F.min(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("__row")
            return keyed.groupBy(*names).agg(row).select("__row.*")

        return _Derived(self, one, "distinctBy")

    def view(self, f: Callable[[DataFrame], DataFrame]) -> DataSource:
        return View(self, f)


@dataclass(frozen=True)
class _Derived(DataSource):
    underlying: DataSource
    f: Callable[[DataFrame], DataFrame]
    counter: str

    def load(self, stats: Stats | None = None) -> DataFrame:
        df = self.f(self.underlying.load(stats))
        return stats.count(stats.count(df, self.counter), "load.dataframe") if stats else df


@dataclass(frozen=True)
class DataFrameSource(DataSource):
    """Any DataFrame: a SQL view, in-memory rows, or the result of other code."""

    df: DataFrame

    def load(self, stats: Stats | None = None) -> DataFrame:
        return stats.count(self.df, "load.dataframe") if stats else self.df


@dataclass(frozen=True)
class View(DataSource):
    """Another data source seen through a projection."""

    underlying: DataSource
    f: Callable[[DataFrame], DataFrame]

    def load(self, stats: Stats | None = None) -> DataFrame:
        return self.underlying.load(stats).transform(self.f)


class Partitions:
    """Relative paths ``pattern % component`` under a base; components may be globs."""

    def __init__(self, pattern: str | Partition, first: Any, *rest: Any):
        pattern = pattern.pattern if isinstance(pattern, Partition) else pattern
        values = [v if isinstance(v, tuple) else (v,) for v in (first, *rest)]
        if any(not isinstance(x, str) for v in values for x in v):
            raise TypeError("partition components are strings")
        self.relative = [pattern % v for v in values]

    @staticmethod
    def unpartitioned() -> None:
        return None


@dataclass(frozen=True)
class Partition:
    """Field names and path pattern of a Hive-style partition."""

    fields: tuple[str, ...]
    pattern: str

    @staticmethod
    def by_field(name: str) -> Partition:
        return Partition((name,), f"{name}=%s")

    @staticmethod
    def by_day() -> Partition:
        return Partition(("year", "month", "day"), "year=%s/month=%s/day=%s")


def _paths(base: str | Sequence[str], partitions: Partitions | None) -> list[str]:
    if not isinstance(base, str):
        return list(base)
    base = base.rstrip("/")
    return [f"{base}/{r}" for r in partitions.relative] if partitions else [f"{base}/*"]


class ParquetSource(DataSource):
    def __init__(self, paths: str | Sequence[str], schema: Schema, partitions: Partitions | None = None):
        self.paths, self.schema = _paths(paths, partitions), schema

    def load(self, stats: Stats | None = None) -> DataFrame:
        df = session().read.schema(self.schema.struct).parquet(*self.paths)
        return stats.count(df, "load.parquet") if stats else df


def decoded(lines: DataFrame, schema: Schema, delimiter: str = "|") -> DataFrame:
    """``__line``, ``__error`` (null for good rows) and the typed fields of delimited lines in
    column ``value``.

    No quoting or escaping; ``\\N`` is null in fields declared optional and no value elsewhere
    but in strings; an empty string is an empty string.
    """
    names, n = schema.names, len(schema.names)
    parts = lines.select(F.col("value").alias("__line"), F.split("value", re.escape(delimiter), -1).alias("__fields"))
    raw = [F.nullif(F.get("__fields", F.lit(i)), F.lit("\\N")) for i in range(n)]
    typed = [r.try_cast(f.dataType) for r, f in zip(raw, schema.struct, strict=True)]
    bad = F.lit(None).cast("string")
    for name, r, t in reversed(list(zip(names, raw, typed, strict=True))):
        wrong = (r.isNotNull() & t.isNull()) if name in schema.optional else t.isNull()
        bad = F.when(wrong, F.concat(F.lit(f"field {name} has another type: "), F.coalesce(r, F.lit("\\N")))).otherwise(bad)
    size = F.size("__fields")
    error = F.when(size < n, F.concat(F.lit(f"fewer than {n} fields: "), F.col("__line"))).when(size > n, F.concat(F.lit(f"more than {n} fields: "), F.col("__line"))).otherwise(bad)
    return parts.select("__line", error.alias("__error"), *[t.alias(name) for name, t in zip(names, typed, strict=True)])


class TextSource(DataSource):
    """Delimited lines; a line that cannot be decoded fails the job, whatever columns are read."""

    def __init__(self, paths: str | Sequence[str], schema: Schema, partitions: Partitions | None = None, delimiter: str = "|"):
        self.paths, self.schema, self.delimiter = _paths(paths, partitions), schema, delimiter

    def load(self, stats: Stats | None = None) -> DataFrame:
        log.info("Loading %s", ", ".join(self.paths))
        d = decoded(session().read.text(self.paths), self.schema, self.delimiter)
        # a filter, as checks in projected columns are pruned with the columns
        df = d.filter(F.when(F.col("__error").isNotNull(), F.raise_error(F.col("__error")).cast("boolean")).otherwise(True)).drop("__line", "__error")
        return stats.count(df, "load.text") if stats else df


def decode_leniently(spark: SparkSession, paths: str | Sequence[str], schema: Schema, delimiter: str = "|") -> tuple[DataFrame, DataFrame]:
    """Good rows, and ``value, error`` of the others."""
    d = decoded(spark.read.text(paths if isinstance(paths, str) else list(paths)), schema, delimiter)
    bad = d.filter(F.col("__error").isNotNull()).select(F.col("__line").alias("value"), F.col("__error").alias("error"))
    return d.filter(F.col("__error").isNull()).drop("__line", "__error"), bad


__all__ = ["DataFrameSource", "DataSource", "ParquetSource", "Partition", "Partitions", "TextSource", "View", "decode_leniently", "decoded"]
