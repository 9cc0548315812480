"""Record schemas, and proxies of records whose attributes are columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Record:
    """A row of one source; ``record.age`` is the column. Subclass it to add derived columns."""

    def __init__(self, column: str, schema: Schema, optional: bool = False):
        self.__dict__.update(_column=column, _schema=schema, _optional=optional)

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        if name not in self._schema.names:
            raise AttributeError(f"{self._schema.name} has no field {name}")
        return F.col(f"{self._column}.`{name}`")

    def __getitem__(self, name: str) -> Column:
        return self.__getattr__(name)

    @property
    def is_defined(self) -> Column:
        """False where the record is the unmatched side of a left join."""
        return F.col(self._column).isNotNull()

    @property
    def is_empty(self) -> Column:
        return F.col(self._column).isNull()

    @property
    def record(self) -> Column:
        return F.col(self._column)


class Schema:
    """Name, fields and optional fields of a record type. ``record`` may be a ``Record`` subclass.

    Optionality is declared here: Spark's ``nullable`` says nothing reliable about it.
    """

    def __init__(self, name: str, fields: str | T.StructType, optional: Iterable[str] = (), record: type[Record] = Record):
        self.name, self.record_type = name, record
        self._fields, self.optional = fields, frozenset(optional)

    @cached_property
    def struct(self) -> T.StructType:
        """The fields; DDL text is parsed at first use, as that needs a running session."""
        parsed = self._fields if isinstance(self._fields, T.StructType) else T.StructType.fromDDL(self._fields)
        if missing := self.optional - set(parsed.names):
            raise ValueError(f"{self.name} has no field {sorted(missing)}")
        return parsed

    @property
    def names(self) -> list[str]:
        return self.struct.names

    @property
    def type_info(self) -> str:
        return self.name

    def record(self, column: str, optional: bool = False) -> Record:
        return self.record_type(column, self, optional)


def args_of(view: Any) -> tuple:
    """A view as the arguments of the next function: tuples are taken apart."""
    return view if isinstance(view, tuple) else (view,)


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
