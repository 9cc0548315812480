"""Descriptive value ranges. They are metadata: nothing checks data against them unless asked."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MinMaxRange:
    min: Any
    max: Any

    def __post_init__(self) -> None:
        if isinstance(self.min, bool) or isinstance(self.max, bool):
            raise TypeError("truth values have no order, so no range")

    def contains(self, value: Any) -> bool:
        return self.min <= value <= self.max

    @property
    def widest_value_size(self) -> int | None:
        return None

    def check(self, value: Column) -> Column:
        return value.between(self.min, self.max)


def _widest(values: Iterable[Any]) -> int | None:
    values = list(values)
    texts = [v for v in values if v is not None]
    if not values or not all(isinstance(v, str) for v in texts) or not texts and None not in values:
        return None
    return max((len(v) for v in texts), default=0)


@dataclass(frozen=True, init=False)
class SetRange:
    values: tuple

    def __init__(self, *values: Any):
        object.__setattr__(self, "values", tuple(dict.fromkeys(values)))

    def contains(self, value: Any) -> bool:
        return value in self.values

    @property
    def widest_value_size(self) -> int | None:
        return _widest(self.values)

    def check(self, value: Column) -> Column:
        known = [v for v in self.values if v is not None]
        return F.coalesce(value.isin(known), F.lit(None in self.values))


@dataclass(frozen=True, init=False)
class MapRange:
    """Values with descriptions, in order of insertion."""

    entries: tuple[tuple[Any, str], ...]

    def __init__(self, *entries: tuple[Any, str]):
        object.__setattr__(self, "entries", tuple(dict(entries).items()))

    @property
    def values(self) -> tuple:
        return tuple(k for k, _ in self.entries)

    def contains(self, value: Any) -> bool:
        return value in self.values

    @property
    def widest_value_size(self) -> int | None:
        return _widest(self.values)

    def check(self, value: Column) -> Column:
        return SetRange(*self.values).check(value)


Range = MinMaxRange | SetRange | MapRange
