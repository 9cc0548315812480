"""Folders that every executor can read, and small size-checked look-ups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
# Option of a write that ``entries`` is to find, whatever the cluster's default is.
MARKED = ("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Where it names none, a session on one machine (``local...``, as in tests) gets a temporary
    folder and has it set as its checkpoint directory; on a cluster, whose executors could not
    read such a folder, this raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/factloom/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's own part of the shared folder; nothing exists there yet.

    What is written there belongs to the application: its file system deletes it when the
    driver ends, and ``release`` before.
    """
    own = _own_dir(spark)
    fs, p = _at(spark, own)
    fs.deleteOnExit(p)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete the tables written so far; results that are yet to be read must not need them."""
    fs, p = _at(spark, _own_dir(spark))
    fs.delete(p, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends in replicated files."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def entries(spark: SparkSession, path: str) -> list[str]:
    """The folders in ``path`` whose writing was finished."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return []
    jvm = spark.sparkContext._jvm
    inside = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory())
    return [x for x in inside if fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """All rows of a table that must be small; raises instead of truncating a larger one."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows, too many for a look-up table held by every task")
    return rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
