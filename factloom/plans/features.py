"""Features, feature sets and their compilation to one DataFrame of facts.

A feature is (presence, value, metadata): presence is a column that is never null, and an absent
feature gives no fact while a present null gives ``\\N``. All features of a set come out of one
projection (or one aggregation) in order of declaration.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import types as ty
from factloom.plans.aggregate import Accumulators, Agg
from factloom.plans.source import ContextSource, Source
from factloom.ranges import Range
from factloom.record import args_of
from factloom.types import FeatureType, ValueType

CARRIERS = {v.carrier: v.spark_type for v in ValueType}


@dataclass(frozen=True)
class Metadata:
    namespace: str
    name: str
    description: str
    feature_type: FeatureType
    value_type: ValueType
    source_type: str
    value_range: Range | None = None

    @property
    def types_conform(self) -> bool:
        return ty.conforms(self.feature_type, self.value_type)


@dataclass(frozen=True)
class FeatureContext:
    """Generation time of a job, in ms since 1970."""

    generation_time: int


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def infer(source: Any, value: Column) -> ValueType:
    """The value type of a column over a source, from the source's declared schema."""
    return ty.value_type_of(source.empty().select(value.alias("v")).schema["v"].dataType)


@dataclass(frozen=True)
class Feature:
    """A named partial function of a source's records, as columns."""

    source: Source | ContextSource
    namespace: str
    name: str
    description: str
    feature_type: FeatureType
    entity: Column
    presence: Column
    value: Column
    value_range: Range | None = None
    declared: ValueType | None = None

    @cached_property
    def value_type(self) -> ValueType:
        return self.declared or infer(self.source, self.value)

    @property
    def metadata(self) -> Metadata:
        return Metadata(self.namespace, self.name, self.description, self.feature_type, self.value_type, self.source.type_info, self.value_range)

    def as_type(self, feature_type: FeatureType) -> Feature:
        """The feature under another statistical type; its range goes."""
        _check(feature_type, self.value_type, self.name)
        return replace(self, feature_type=feature_type, value_range=None)

    def apply(self, df: DataFrame) -> DataFrame:
        """``entity, name, value`` for the rows where the feature is present."""
        return df.filter(self.presence).select(self.entity.alias("entity"), F.lit(self.name).alias("name"), ty.lift(self.value, self.value_type).alias("value"))


@dataclass(frozen=True)
class AggregationFeature:
    """A named aggregate over the rows of an entity that its view keeps."""

    name: str
    description: str
    feature_type: FeatureType
    agg: Agg
    view: Any
    guard: Column | None = None
    having: tuple[Callable[[Accumulators], Column], ...] = ()
    value_range: Range | None = None
    declared: ValueType | None = None

    def compiled(self, i: int) -> tuple[dict[str, Column], Column, Column]:
        """Aggregate columns by name, presence and value over them."""
        here = F.lit(True) if self.guard is None else _true(self.guard)
        acc = Accumulators(self.agg.make, self.view, here, f"a{i}")
        value = self.agg.present(acc)
        present = F.lit(True)
        columns: dict[str, Column] = {}
        if self.guard is not None:
            columns[f"a{i}__rows"] = F.count_if(here)
            present = F.col(f"a{i}__rows") > 0
        for h in self.having:
            present = present & _true(h(acc))
        return columns | acc._used, present, value

    def value_type(self, source: Any) -> ValueType:
        if self.declared:
            return self.declared
        columns, _, value = self.compiled(0)
        df = source.empty().groupBy(F.lit("e").alias("entity")).agg(*[c.alias(k) for k, c in columns.items()])
        return ty.value_type_of(df.select(value.alias("v")).schema["v"].dataType)


def _check(feature_type: FeatureType, value_type: ValueType, name: str) -> None:
    if not ty.conforms(feature_type, value_type):
        raise ValueError(f"{name}: {value_type.name} cannot be {feature_type.name}")


def general(source, namespace, name, description, feature_type, entity, value, presence=None, value_range=None, value_type=None) -> Feature:
    """The pattern all row features reduce to; statistical and value type are not checked here."""
    args = args_of(source.view())
    p = F.lit(True) if presence is None else presence(*args)
    return Feature(source, namespace, name, description, feature_type, entity(*args), p, value(*args), value_range, value_type)


class FeatureSetBuilder:
    """Fluent declaration: ``builder.map/collect/select(...).where(...).as_feature(...)``."""

    def __init__(self, source: Any, namespace: str, entity: Callable[..., Column], view: Any = None, guard: Column | None = None):
        self.source, self.namespace, self.entity, self.guard = source, namespace, entity, guard
        self.view = source.view() if view is None else view

    def map(self, f: Callable[..., Any]) -> FeatureSetBuilder:
        return FeatureSetBuilder(self.source, self.namespace, self.entity, f(*args_of(self.view)), self.guard)

    def collect(self, when: Callable[..., Column], get: Callable[..., Any] | None = None) -> FeatureSetBuilder:
        """A partial view: rows where ``when`` holds, seen as ``get`` of them."""
        held = _true(when(*args_of(self.view)))
        guard = held if self.guard is None else self.guard & held
        view = get(*args_of(self.view)) if get else self.view
        return FeatureSetBuilder(self.source, self.namespace, self.entity, view, guard)

    def select(self, value: Callable[..., Column] | Agg) -> FeatureBuilder | AggregationFeatureBuilder:
        if isinstance(value, Agg):
            return AggregationFeatureBuilder(self, value)
        return FeatureBuilder(self, value(*args_of(self.view)))

    __call__ = select

    def as_feature(self, feature_type: FeatureType, name: str, *about: Any, value_type: ValueType | None = None) -> Feature:
        return FeatureBuilder(self, self.view).as_feature(feature_type, name, *about, value_type=value_type)


def _about(about: tuple) -> tuple[Range | None, str]:
    return (about[0], about[1]) if len(about) == 2 else (None, about[0])


@dataclass(frozen=True)
class FeatureBuilder:
    base: FeatureSetBuilder
    value: Column
    conditions: tuple[Column, ...] = ()

    def where(self, condition: Callable[..., Column]) -> FeatureBuilder:
        """Of the view, not of the value; a miss makes the feature absent."""
        return replace(self, conditions=(*self.conditions, _true(condition(*args_of(self.base.view)))))

    and_where = where

    def as_feature(self, feature_type: FeatureType, name: str, *about: Any, value_type: ValueType | None = None) -> Feature:
        """``as_feature(type, name, [range,] description)``; raises where the types do not conform."""
        value_range, description = _about(about)
        b = self.base
        presence = F.lit(True) if b.guard is None else b.guard
        for c in self.conditions:
            presence = presence & c
        f = Feature(b.source, b.namespace, name, description, feature_type, b.entity(*args_of(b.source.view())), presence, self.value, value_range, value_type)
        _check(feature_type, f.value_type, name)
        return f


@dataclass(frozen=True)
class AggregationFeatureBuilder:
    base: FeatureSetBuilder
    agg: Agg
    conditions: tuple[Column, ...] = ()
    tests: tuple[Callable[[Accumulators], Column], ...] = ()

    def where(self, condition: Callable[..., Column]) -> AggregationFeatureBuilder:
        return replace(self, conditions=(*self.conditions, _true(condition(*args_of(self.base.view)))))

    and_where = where

    def having(self, test: Callable[[Accumulators], Column]) -> AggregationFeatureBuilder:
        return replace(self, tests=(*self.tests, test))

    def as_feature(self, feature_type: FeatureType, name: str, *about: Any, value_type: ValueType | None = None) -> AggregationFeature:
        value_range, description = _about(about)
        guard = self.base.guard
        for c in self.conditions:
            guard = c if guard is None else guard & c
        f = AggregationFeature(name, description, feature_type, self.agg, self.base.view, guard, self.tests, value_range, value_type)
        _check(feature_type, f.value_type(self.base.source), name)
        return f


def _fact(name: str, value_type: ValueType, present: Column, value: Column, encoded: bool) -> Column:
    lifted = ty.lift(value, value_type)
    if encoded:
        return F.when(present, F.struct(F.lit(name).alias("attribute"), ty.encode(lifted, value_type).alias("value")))
    carried = [(lifted if c == value_type.carrier else F.lit(None).cast(t)).alias(c) for c, t in CARRIERS.items()]
    return F.when(present, F.struct(F.lit(name).alias("name"), F.lit(value_type.json_name).alias("value_type"), *carried))


def _inlined(df: DataFrame, entity: Column, time: Column, facts: Sequence[Column]) -> DataFrame:
    there = F.array_compact(F.array(*facts))
    return df.select(entity.cast("string").alias("entity"), time.alias("time"), F.inline(there))


def eavt(encoded: DataFrame) -> DataFrame:
    """Encoded facts as ``entity, attribute, value, time`` with the day of the time as text.

    The day is that of the session's time zone, which jobs should set (UTC by default here).
    """
    return encoded.select("entity", "attribute", "value", F.date_format(F.timestamp_millis("time"), "yyyy-MM-dd").alias("time"))


class MetadataSet:
    """Name and metadata; the features may be computed elsewhere."""

    @property
    def name(self) -> str:
        return type(self).__name__

    metadata: Sequence[Metadata] = ()


class FeatureSet(MetadataSet):
    """A group of features over one source. Subclasses set ``namespace``, ``source``, ``entity``
    (records -> column) and ``features``."""

    namespace: str
    source: Source | ContextSource
    features: Sequence[Feature] = ()

    def entity(self, *records: Any) -> Column:
        raise NotImplementedError

    def time(self, *records: Any, context: FeatureContext) -> Column:
        """Time of a record's facts in ms; the job's generation time unless overridden."""
        return F.lit(context.generation_time).cast("bigint")

    @property
    def builder(self) -> FeatureSetBuilder:
        return FeatureSetBuilder(self.source, self.namespace, self.entity)

    @property
    def metadata(self) -> list[Metadata]:
        return [f.metadata for f in self.features]

    def generate(self, df: DataFrame, context: FeatureContext, encoded: bool = False) -> DataFrame:
        """Facts of a bound source's rows: typed (one carrier column per value type), or encoded
        as ``entity, time, attribute, value``."""
        args = args_of(self.source.view())
        facts = [_fact(f.name, f.value_type, _true(f.presence), f.value, encoded) for f in self.features]
        return _inlined(df, self.features[0].entity, self.time(*args, context=context), facts)

    def apply(self, df: DataFrame, context: FeatureContext | None = None) -> DataFrame:
        return self.generate(df, context or FeatureContext(0)).drop("time")


class BasicFeatureSet(FeatureSet):
    def basic_feature(self, name: str, description: str, feature_type: FeatureType, value: Callable[..., Column], value_range: Range | None = None, value_type: ValueType | None = None) -> Feature:
        """Always present; null values are facts."""
        return general(self.source, self.namespace, name, description, feature_type, self.entity, value, None, value_range, value_type)


class PivotFeatureSet(FeatureSet):
    def pivot(self, field: str, description: str, feature_type: FeatureType, value_range: Range | None = None, value_type: ValueType | None = None) -> Feature:
        """A field as a feature of its name, always present."""
        return general(self.source, self.namespace, field, description, feature_type, self.entity, lambda r: r[field], None, value_range, value_type)


class QueryFeatureSet(FeatureSet):
    """Features that share ``feature_type`` and ``value`` and differ in their filters."""

    feature_type: FeatureType

    def value(self, *records: Any) -> Column:
        raise NotImplementedError

    def query_feature(self, name: str, description: str, filter: Callable[..., Column], value_range: Range | None = None, value_type: ValueType | None = None) -> Feature:
        return general(self.source, self.namespace, name, description, self.feature_type, self.entity, self.value, filter, value_range, value_type)


class AggregationFeatureSet(MetadataSet):
    """Aggregates per entity: one ``groupBy(entity)`` with all aggregators of the set."""

    namespace: str
    source: Source | ContextSource
    aggregation_features: Sequence[AggregationFeature] = ()

    def entity(self, *records: Any) -> Column:
        raise NotImplementedError

    @property
    def builder(self) -> FeatureSetBuilder:
        return FeatureSetBuilder(self.source, self.namespace, self.entity)

    @property
    def metadata(self) -> list[Metadata]:
        kind = f"Tuple2[String,Iterable[{self.source.type_info}]]"
        return [Metadata(self.namespace, f.name, f.description, f.feature_type, f.value_type(self.source), kind, f.value_range) for f in self.aggregation_features]

    def generate(self, df: DataFrame, context: FeatureContext, encoded: bool = False) -> DataFrame:
        columns: dict[str, Column] = {}
        facts = []
        for i, f in enumerate(self.aggregation_features):
            own, present, value = f.compiled(i)
            columns |= own
            facts.append(_fact(f.name, f.value_type(self.source), _true(present), value, encoded))
        key = self.entity(*args_of(self.source.view()))
        grouped = df.groupBy(key.alias("__entity")).agg(*[c.alias(n) for n, c in columns.items()])
        return _inlined(grouped, F.col("__entity"), F.lit(context.generation_time).cast("bigint"), facts)

    def apply(self, df: DataFrame, context: FeatureContext | None = None) -> DataFrame:
        return self.generate(df, context or FeatureContext(0)).drop("time")


@dataclass(frozen=True)
class FeatureStub:
    """A metadata-only declaration."""

    source_type: str
    value_type: ValueType

    def as_feature_metadata(self, feature_type: FeatureType, namespace: str, name: str, *about: Any) -> Metadata:
        value_range, description = _about(about)
        return Metadata(namespace, name, description, feature_type, self.value_type, self.source_type, value_range)
