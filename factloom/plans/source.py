"""Feature sources: what a feature set is declared over, without a location.

A bound source is one DataFrame with a struct column per joined record (``s1``, ``s2``, ...) and
``ctx`` for the job's context. The left side's fields of an unmatched left join are one null
struct, so "no match" differs from "matched a row of nulls".
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.record import Record, Schema, args_of
from factloom.stats import Stats

Predicate = Callable[..., Column]


def _packed(df: DataFrame, schema: Schema, name: str) -> DataFrame:
    """The declared fields, in the declared types, as one struct column."""
    there = {f.name: f.dataType for f in df.schema}
    fields = [F.col(f"`{f.name}`") if there.get(f.name) == f.dataType else F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.struct]
    return df.select(F.struct(*fields).alias(name))


@dataclass(frozen=True)
class _Step:
    schema: Schema
    how: str
    left_key: Callable[..., Any]
    right_key: Callable[[Record], Any]
    null_safe: bool


@dataclass(frozen=True)
class Source:
    """One table, or a left-deep chain of inner and left equi-joins of any length."""

    first: Schema
    steps: tuple[_Step, ...] = ()
    filters: tuple[tuple[int, Predicate], ...] = ()

    @property
    def width(self) -> int:
        return 1 + len(self.steps)

    def records(self, n: int | None = None) -> tuple[Record, ...]:
        out = [self.first.record("s1")] + [s.schema.record(f"s{i}", s.how == "left") for i, s in enumerate(self.steps, 2)]
        return tuple(out[: n or self.width])

    def view(self) -> Any:
        r = self.records()
        return r if len(r) > 1 else r[0]

    def filter(self, predicate: Predicate) -> Source:
        """Rows of the whole join; filters chain, and hold for later extensions of the join too."""
        return replace(self, filters=(*self.filters, (self.width, predicate)))

    # joins
    def inner(self, schema: Schema) -> _Incomplete:
        return _Incomplete(self, schema, "inner")

    def left(self, schema: Schema) -> _Incomplete:
        return _Incomplete(self, schema, "left")

    inner_join_to, left_join_to = inner, left

    def with_context(self, schema: Schema | None = None) -> ContextSource:
        return ContextSource(self, schema)

    def builder(self, namespace: str, entity: Callable[..., Column]):
        from factloom.plans.features import FeatureSetBuilder

        return FeatureSetBuilder(self, namespace, entity)

    @property
    def type_info(self) -> str:
        parts = [self.first.type_info] + [f"Option[{s.schema.type_info}]" if s.how == "left" else s.schema.type_info for s in self.steps]
        return parts[0] if len(parts) == 1 else f"Tuple{len(parts)}[{','.join(parts)}]"

    def empty(self) -> DataFrame:
        """No rows, but the columns, for resolving types without data."""
        from factloom.record import session

        df = session().range(0).select(F.lit(None).cast(self.first.struct).alias("s1"), *[F.lit(None).cast(s.schema.struct).alias(f"s{i}") for i, s in enumerate(self.steps, 2)])
        return df

    def bind(self, binder: Binder) -> BoundSource:
        return BoundSource(self, binder)

    def load(self, binder: Binder, stats: Stats | None = None) -> DataFrame:
        datasets = binder.datasets
        if len(datasets) != self.width or binder.shape is not None and binder.shape != tuple(s.how for s in self.steps):
            raise ValueError(f"the source joins {self.width} tables as {[s.how for s in self.steps]}, the binder has {len(datasets)} as {binder.shape}")
        out = _packed(datasets[0].load(stats), self.first, "s1")
        records = self.records()
        for i, step in enumerate(self.steps):
            right = _packed(datasets[i + 1].load(stats), step.schema, f"s{i + 2}")
            left_keys, right_keys = args_of(step.left_key(*records[: i + 1])), args_of(step.right_key(records[i + 1]))
            if len(left_keys) != len(right_keys):
                raise ValueError("join keys of different width")
            match = None
            for a, b in zip(left_keys, right_keys, strict=True):
                same = a.eqNullSafe(b) if step.null_safe else a == b
                match = same if match is None else match & same
            out = out.join(right, match, step.how)
            if stats:
                out = stats.count(out, f"join.level{i + 1}")
        for width, predicate in self.filters:
            out = out.filter(predicate(*records[:width]))
        if stats and self.filters:
            out = stats.count(out, "filter")
        return out


@dataclass(frozen=True)
class _Incomplete:
    source: Source
    schema: Schema
    how: str

    def on(self, left_key: Callable[..., Any], right_key: Callable[[Record], Any], null_safe: bool = False) -> Source:
        """Keys are columns or tuples of columns; ``left_key`` sees all earlier records.

        Null keys match nothing unless ``null_safe``, which is for keys declared optional.
        """
        step = _Step(self.schema, self.how, left_key, right_key, null_safe)
        return replace(self.source, steps=(*self.source.steps, step))


def From(schema: Schema) -> Source:  # noqa: N802
    return Source(schema)


class _To:
    def __init__(self, schema: Schema, how: str):
        self.schema, self.how = schema, how

    def to(self, other: Schema) -> _Incomplete:
        return _Incomplete(Source(self.schema), other, self.how)


class Join(_To):
    """``Join(L).to(R).on(...)``, ``Join.left(L).to(R).on(...)``, ``Join.multiway(A).inner(B)...``."""

    def __init__(self, schema: Schema):
        super().__init__(schema, "inner")

    @staticmethod
    def join(schema: Schema) -> Join:
        return Join(schema)

    @staticmethod
    def left(schema: Schema) -> _To:
        return _To(schema, "left")

    @staticmethod
    def multiway(schema: Schema) -> Source:
        return Source(schema)


@dataclass(frozen=True)
class ContextSource:
    """Pairs every record with one value of the job; its filters see records and context."""

    underlying: Source
    schema: Schema | None = None
    filters: tuple[Predicate, ...] = ()

    def filter(self, predicate: Predicate) -> ContextSource:
        return replace(self, filters=(*self.filters, predicate))

    def view(self) -> Any:
        ctx = self.schema.record("ctx") if self.schema else F.col("ctx")
        return (*self.underlying.records(), ctx)

    def records(self) -> tuple:
        return self.view()

    def builder(self, namespace: str, entity: Callable[..., Column]):
        from factloom.plans.features import FeatureSetBuilder

        return FeatureSetBuilder(self, namespace, entity)

    @property
    def type_info(self) -> str:
        return f"Tuple2[{self.underlying.type_info},{self.schema.type_info if self.schema else 'Context'}]"

    def empty(self) -> DataFrame:
        kind = self.schema.struct if self.schema else "string"
        return self.underlying.empty().withColumn("ctx", F.lit(None).cast(kind))

    def bind_with_context(self, binder: Binder, ctx: Any) -> BoundSource:
        return BoundSource(self, binder, ctx)

    def load(self, binder: Binder, ctx: Any, stats: Stats | None = None) -> DataFrame:
        df = self.underlying.load(binder, stats)
        if self.schema:
            values = ctx if isinstance(ctx, dict) else dict(zip(self.schema.names, args_of(ctx), strict=True))
            value = F.struct(*[F.lit(values[f.name]).cast(f.dataType).alias(f.name) for f in self.schema.struct])
        else:
            value = ctx if isinstance(ctx, Column) else F.lit(ctx)
        df = df.withColumn("ctx", value)
        for p in self.filters:
            df = df.filter(p(*self.view()))
        return df


@dataclass(frozen=True)
class BoundSource:
    source: Any
    binder: Binder
    ctx: Any = None

    def load(self, stats: Stats | None = None) -> DataFrame:
        if isinstance(self.source, ContextSource):
            return self.source.load(self.binder, self.ctx, stats)
        return self.source.load(self.binder, stats)


@dataclass(frozen=True)
class Binder:
    """Data sources matched to a source's shape (None: any shape)."""

    datasets: tuple
    shape: tuple[str, ...] | None = field(default=None)


def from_(ds: Any) -> Binder:
    return Binder((ds,), ())


def join(left: Any, right: Any) -> Binder:
    return Binder((left, right), ("inner",))


def left_join(left: Any, right: Any) -> Binder:
    return Binder((left, right), ("left",))


def join_multi(*datasets: Any) -> Binder:
    return Binder(datasets)


def lift_join(left: DataFrame, right: DataFrame, left_key: Callable[[DataFrame], Any], right_key: Callable[[DataFrame], Any], how: str = "inner") -> DataFrame:
    """Two DataFrames joined without a declared source: struct columns ``s1`` and ``s2``."""
    a, b = Schema("L", left.schema), Schema("R", right.schema)
    src = Source(a).inner(b) if how == "inner" else Source(a).left(b)
    from factloom.sources.data import DataFrameSource

    return src.on(left_key, right_key).load(join_multi(DataFrameSource(left), DataFrameSource(right)))
