"""Aggregators: named accumulator columns and an expression over them.

An accumulator is a function from the view's presence column to an aggregate column, so every
aggregator of a set runs in the set's one ``groupBy(entity).agg(...)``. ``having`` sees the
accumulators, not the presented value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.record import args_of


class Accumulators:
    """Accumulators by attribute; only those that are used are computed."""

    def __init__(self, make: dict[str, Callable[[Any, Column], Column]], view: Any, here: Column, prefix: str):
        self._make, self._view, self._here, self._prefix = make, view, here, prefix
        self._used: dict[str, Column] = {}

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_") or name not in self._make:
            raise AttributeError(name)
        column = f"{self._prefix}_{name}"
        self._used.setdefault(column, self._make[name](self._view, self._here))
        return F.col(column)


@dataclass(frozen=True)
class Agg:
    """``make``: accumulator name -> (view, presence) -> aggregate column; ``present``: accumulators -> value."""

    make: dict[str, Callable[[Any, Column], Column]]
    present: Callable[[Accumulators], Column]

    def and_then(self, f: Callable[[Column], Column]) -> Agg:
        return replace(self, present=lambda a: f(self.present(a)))


def _of(view: Any, f: Callable[..., Column]) -> Column:
    return f(*args_of(view))


def _in(view: Any, here: Column, f: Callable[..., Column]) -> Column:
    return F.when(here, _of(view, f))


def size() -> Agg:
    return Agg({"n": lambda v, p: F.count_if(p)}, lambda a: a.n)


def count(where: Callable[..., Column] | None = None) -> Agg:
    """Rows that match; 0 is a value."""
    return Agg({"n": lambda v, p: F.count_if(p & F.coalesce(_of(v, where), F.lit(False)) if where else p)}, lambda a: a.n)


def avg(value: Callable[..., Column]) -> Agg:
    """Mean as double; ``having`` sees ``count`` and ``mean``."""
    x = lambda v, p: _in(v, p, value).cast("double")
    return Agg({"count": lambda v, p: F.count(x(v, p)), "mean": lambda v, p: F.avg(x(v, p))}, lambda a: a.mean)


def avg_decimal(value: Callable[..., Column]) -> Agg:
    x = lambda v, p: _in(v, p, value).cast("decimal(38,18)")
    return Agg({"count": lambda v, p: F.count(x(v, p)), "value": lambda v, p: F.avg(x(v, p))}, lambda a: a.value)


def max_(value: Callable[..., Column], optional: bool = False) -> Agg:
    """Largest value; a missing value is the smallest of all."""
    return Agg({"value": lambda v, p: F.max(_in(v, p, value))}, lambda a: a.value)


def min_(value: Callable[..., Column], optional: bool = False) -> Agg:
    """Smallest value; of an ``optional`` one a missing value is the smallest and wins."""
    if not optional:
        return Agg({"value": lambda v, p: F.min(_in(v, p, value))}, lambda a: a.value)
    missing = lambda v, p: F.count_if(p & _of(v, value).isNull())
    return Agg({"low": lambda v, p: F.min(_in(v, p, value)), "missing": missing}, lambda a: F.when(a.missing == 0, a.low))


def _record(view: Any) -> Column:
    parts = [x.record if hasattr(x, "record") and not isinstance(x, Column) else x for x in args_of(view)]
    return parts[0] if len(parts) == 1 else F.struct(*[p.alias(f"_{i}") for i, p in enumerate(parts, 1)])


def _by(pick: Callable[[Column, Column], Column], order: Callable[..., Column], value: Callable[..., Column]) -> Agg:
    rank = lambda v, p: F.when(p, F.struct(_of(v, order).alias("o"), _of(v, value).alias("v")))
    return Agg({"value": lambda v, p: pick(_of(v, value), rank(v, p)), "record": lambda v, p: pick(_record(v), rank(v, p))}, lambda a: a.value)


def max_by(order: Callable[..., Column], value: Callable[..., Column]) -> Agg:
    """Value of the row with the largest (order, value); ``having`` may see the whole ``record``."""
    return _by(F.max_by, order, value)


def min_by(order: Callable[..., Column], value: Callable[..., Column]) -> Agg:
    return _by(F.min_by, order, value)


def sum_(value: Callable[..., Column]) -> Agg:
    return Agg({"value": lambda v, p: F.sum(_in(v, p, value))}, lambda a: a.value)


def unique_count_by(value: Callable[..., Column]) -> Agg:
    """Exact number of distinct values, a missing one included. Two or more in one set make
    Spark expand the rows once per aggregator; declare them in sets of their own where rows are many."""
    return Agg({"n": lambda v, p: F.count_distinct(F.when(p, F.struct(_of(v, value))))}, lambda a: a.n)


def moments(value: Callable[..., Column], present: Callable[[Accumulators], Column]) -> Agg:
    x = lambda v, p: _in(v, p, value).cast("double")
    make = {"n": lambda v, p: F.count(x(v, p)), "mean": lambda v, p: F.avg(x(v, p))}
    for name, f in (("sd", F.stddev_pop), ("var", F.var_pop), ("skew", F.skewness), ("kurt", F.kurtosis)):
        make[name] = lambda v, p, f=f: f(x(v, p))
    return Agg(make, present)


def _nan_unless(ok: Column, value: Column) -> Column:
    return F.when(ok, F.coalesce(value, F.lit(float("nan")))).otherwise(F.lit(float("nan")))


def stddev(value: Callable[..., Column]) -> Agg:
    """Population standard deviation; NaN for fewer than two values."""
    return moments(value, lambda a: _nan_unless(a.n > 1, a.sd))


def variance(value: Callable[..., Column]) -> Agg:
    return moments(value, lambda a: _nan_unless(a.n > 1, a.var))


def skewness(value: Callable[..., Column]) -> Agg:
    return moments(value, lambda a: _nan_unless(a.n > 1, a.skew))


def kurtosis(value: Callable[..., Column]) -> Agg:
    return moments(value, lambda a: _nan_unless(a.n > 1, a.kurt))


def of(**accumulators: Callable[[Column, Column], Column]):
    """A custom aggregator from Spark aggregates: ``of(total=lambda v, here: F.sum(F.when(here, v.x)))(lambda a: a.total)``."""
    return lambda present: Agg(dict(accumulators), present)
