"""Sinks: encoded facts in partitions that a marker commits, after which they are closed.

Writing goes to a folder of its own and is moved in per partition, after every target has been
checked, so that a refused write leaves nothing behind. All file operations use Hadoop's file
systems and run on the driver; data are written by the executors.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.metadata import Json1, MetadataWriter
from factloom.plans.features import MetadataSet, eavt
from factloom.record import session
from factloom.sources.data import Partition
from factloom.stats import Stats
from factloom.types import NULL_TEXT

SUCCESS = "_SUCCESS"
_QUIET = ("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")


class AttemptedWriteToCommitted(Exception):
    exit_code = -3

    def __init__(self, paths: Iterable[str]):
        self.paths = sorted(paths)
        super().__init__(f"attempted write to committed partitions {self.paths}")


class AlreadyCommitted(Exception):
    exit_code = -2

    def __init__(self, paths: Iterable[str]):
        self.paths = sorted(paths)
        super().__init__(f"already committed: {self.paths}")


class Files:
    """Hadoop file operations."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[tuple[str, bool]]:
        fs, p = self._at(path)
        return [(s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(p)] if fs.exists(p) else []

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def move(self, source: str, target: str) -> None:
        fs, a = self._at(source)
        if not fs.rename(a, self._at(target)[1]):
            raise OSError(f"could not move {source} to {target}")

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def put(self, path: str, text: str = "") -> None:
        fs, p = self._at(path)
        out = fs.create(p, True)
        if text:
            out.write(bytearray(text.encode()))
        out.close()

    def get(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def leaves(self, root: str, below: str = "") -> list[str]:
        """Relative folders that hold data files."""
        found, own = [], False
        for name, is_dir in self.names(f"{root}/{below}" if below else root):
            if name.startswith(("_", ".")):
                continue
            if is_dir:
                found += self.leaves(root, f"{below}/{name}" if below else name)
            else:
                own = True
        return found + ([below] if own else [])


def is_committed(path: str) -> bool:
    return Files(session()).exists(f"{path}/{SUCCESS}")


def commit(paths: Iterable[str]) -> None:
    """Marks all partitions, or none if any is committed already."""
    files, paths = Files(session()), sorted(set(paths))
    if done := [p for p in paths if files.exists(f"{p}/{SUCCESS}")]:
        raise AlreadyCommitted(done)
    for p in paths:
        files.put(f"{p}/{SUCCESS}")


@dataclass(frozen=True)
class FixedSinkPartition:
    partition: Partition
    values: tuple[str, ...]

    @staticmethod
    def by_day(day: str) -> FixedSinkPartition:
        """``day`` as ``yyyy-MM-dd``."""
        return FixedSinkPartition(Partition.by_day(), tuple(day.split("-")))

    @property
    def path(self) -> str:
        return self.partition.pattern % self.values

    def columns(self) -> dict[str, Column]:
        return {f: F.lit(v) for f, v in zip(self.partition.fields, self.values, strict=True)}


@dataclass(frozen=True)
class DerivedSinkPartition:
    """Partition values from the encoded row."""

    partition: Partition
    values: tuple[Callable[[DataFrame], Column], ...]

    @staticmethod
    def by_field(name: str) -> DerivedSinkPartition:
        return DerivedSinkPartition(Partition.by_field(name), (lambda df: df[name].cast("string"),))

    @staticmethod
    def by_day(column: str, pattern: str = "yyyy-MM-dd") -> DerivedSinkPartition:
        """Year, month and day of a text column of the given date pattern."""
        day = lambda df, p: F.date_format(F.to_timestamp(df[column], pattern), p)
        return DerivedSinkPartition(Partition.by_day(), tuple((lambda df, p=p: day(df, p)) for p in ("yyyy", "MM", "dd")))

    @staticmethod
    def eavt_by_day() -> DerivedSinkPartition:
        return DerivedSinkPartition.by_day("time")


SinkPartition = FixedSinkPartition | DerivedSinkPartition


def fail_job(column: str, text: Column, delimiter: str) -> Column:
    """The default for a field that holds the delimiter."""
    message = F.concat(F.lit(f"field {column} contains the delimiter '{delimiter}': "), text)
    return F.when(text.contains(delimiter), F.raise_error(message).cast("string")).otherwise(text)


Conflict = Callable[[str, Column, str], Column | None]


def serialised(df: DataFrame, delimiter: str = "|", conflict: Conflict = fail_job) -> Column:
    """A row as text: fields joined by the delimiter, ``\\N`` for null, no quoting.

    ``conflict`` gets the column's name, its text and the delimiter and returns the text to use;
    a replacement that still holds the delimiter fails the job. Returning None leaves the column
    out; a null of the returned text leaves the field out of its row.
    """
    fields = []
    for name in df.columns:
        text = F.col(f"`{name}`").cast("string")
        answer = conflict(name, text, delimiter)
        if answer is None:
            continue
        answer = fail_job(name, answer, delimiter)
        fields.append(F.when(text.isNull(), F.lit(NULL_TEXT)).otherwise(answer))
    return F.concat_ws(delimiter, *fields)


Encoder = Callable[[DataFrame], DataFrame]


class FeatureSink(Protocol):
    def write(self, facts: DataFrame, metadata: MetadataSet, stats: Stats | None = None) -> set[str]:
        """Writes encoded facts; the partitions written. Raises where one is committed."""


def _place(files: Files, staged: str, target: str) -> set[str]:
    leaves = files.leaves(staged)
    targets = {leaf: f"{target}/{leaf}" if leaf else target for leaf in leaves}
    if closed := [t for t in targets.values() if files.exists(f"{t}/{SUCCESS}")]:
        files.remove(staged)
        raise AttemptedWriteToCommitted(closed)
    for leaf, t in targets.items():
        files.make(t)
        for name, is_dir in files.names(f"{staged}/{leaf}" if leaf else staged):
            if not is_dir and not name.startswith(("_", ".")):
                files.move(f"{staged}/{leaf}/{name}" if leaf else f"{staged}/{name}", f"{t}/{name}")
    files.remove(staged)
    return set(targets.values())


@contextmanager
def _removed_on_failure(files: Files, staged: str) -> Iterator[None]:
    try:
        yield
    except BaseException:
        files.remove(staged)
        raise


def _checked_name(name: str) -> str:
    if not re.fullmatch(r"\w+", name):
        raise ValueError(f"bad table name {name}")
    return name


@dataclass
class TextSink:
    """Delimited text in Hive-style partitions, exposed as a table."""

    database: str
    path: str
    table: str
    partition: SinkPartition
    delimiter: str = "|"
    conflict: Conflict = field(default=fail_job)
    encoder: Encoder = field(default=eavt)

    def write(self, facts: DataFrame, metadata: MetadataSet, stats: Stats | None = None) -> set[str]:
        files = Files(facts.sparkSession)
        rows = self.encoder(facts)
        columns = rows.columns
        parts = self.partition.columns() if isinstance(self.partition, FixedSinkPartition) else {f: v(rows) for f, v in zip(self.partition.partition.fields, self.partition.values, strict=True)}
        if stats:
            rows = stats.count(rows, "write.text")
        if isinstance(self.partition, FixedSinkPartition) and is_committed(f"{self.path}/{self.partition.path}"):
            raise AttemptedWriteToCommitted([f"{self.path}/{self.partition.path}"])
        text = rows.select(serialised(rows.select(*columns), self.delimiter, self.conflict).alias("value"), *[c.alias(n) for n, c in parts.items()])
        staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
        with _removed_on_failure(files, staged):
            text.write.option(*_QUIET).partitionBy(*self.partition.partition.fields).text(staged)
            written = _place(files, staged, self.path)
        ensure_text_table(facts.sparkSession, self.database, self.table, self.path, columns, self.partition.partition.fields, self.delimiter)
        return written


def ensure_text_table(spark: SparkSession, database: str, table: str, path: str, columns: Sequence[str], partition: Sequence[str], delimiter: str) -> None:
    """The table over a text sink's folder, with its partitions; safe to repeat.

    The external table ``TABLE_lines`` holds the lines; ``TABLE`` is a view of their fields, in
    which empty strings stay empty and ``\\N`` is null. Filters on the partition's fields reach
    the files through the view.
    """
    name, lines = f"`{_checked_name(database)}`.`{_checked_name(table)}`", f"`{database}`.`{table}_lines`"
    keys = ", ".join(f"`{p}`" for p in partition)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {lines} (value STRING, {', '.join(f'`{p}` STRING' for p in partition)}) USING text PARTITIONED BY ({keys}) LOCATION '{path}'")
    spark.sql(f"MSCK REPAIR TABLE {lines}")
    spark.catalog.refreshTable(f"{database}.{table}_lines")
    at = "\\\\Q" + delimiter.replace("'", "\\'") + "\\\\E"
    fields = ", ".join(f"nullif(get(f, {i}), '\\\\N') AS `{c}`" for i, c in enumerate(columns))
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT {fields}, {keys} FROM (SELECT split(value, '{at}', -1) AS f, {keys} FROM {lines})")


@dataclass
class ParquetSink:
    """Parquet in one fixed partition, checked before anything is computed."""

    database: str
    table: str
    path: str
    partition: FixedSinkPartition
    encoder: Encoder = field(default=eavt)

    def write(self, facts: DataFrame, metadata: MetadataSet, stats: Stats | None = None) -> set[str]:
        spark, target = facts.sparkSession, f"{self.path}/{self.partition.path}"
        if is_committed(target):
            raise AttemptedWriteToCommitted([target])
        rows = self.encoder(facts)
        columns = rows.dtypes
        if stats:
            rows = stats.count(rows, "write.parquet")
        files, staged = Files(spark), f"{self.path}/_staged-{uuid.uuid4().hex}"
        with _removed_on_failure(files, staged):
            rows.write.option(*_QUIET).parquet(staged)
            _place(files, staged, target)
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{_checked_name(self.database)}`")
        name = f"`{self.database}`.`{_checked_name(self.table)}`"
        fields = ", ".join([f"`{c}` {t}" for c, t in columns] + [f"`{p}` STRING" for p in self.partition.partition.fields])
        keys = ", ".join(f"`{p}`" for p in self.partition.partition.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet PARTITIONED BY ({keys}) LOCATION '{self.path}'")
        spark.sql(f"MSCK REPAIR TABLE {name}")
        return {target}


@dataclass
class MetadataSink:
    """Another sink, with the set's metadata as a file in every partition written."""

    underlying: FeatureSink
    writer: MetadataWriter = field(default=Json1)

    def write(self, facts: DataFrame, metadata: MetadataSet, stats: Stats | None = None) -> set[str]:
        written = self.underlying.write(facts, metadata, stats)
        text, files = self.writer.stringify(self.writer.output([metadata])), Files(facts.sparkSession)
        for path in written:
            files.put(f"{path}/_feature_metadata/_{metadata.name}_METADATA.V{self.writer.version}.json", text)
        return written
