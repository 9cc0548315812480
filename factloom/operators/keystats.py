"""Per-key statistics that no hot key can hold up: dense accumulators on equal input splits.

Every task dictionary-encodes the keys of its own split of the input and adds the values into
dense arrays (``numpy.bincount``), so a key with a third of all rows costs each task one array
slot. The arrays leave a task cut into blocks by a hash of the key; the blocks of one number
are summed wherever they meet, again by scatter-add. A key travels at most once per split and
flush, whatever its number of rows. Squares are summed around the mean, so that deviations
stay right where values are large.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTIAL = "field int, block int, keys array<string>, n_rows array<bigint>, n array<bigint>, s array<double>, m2 array<double>"
MERGED = "field int, key_value string, n_rows bigint, n bigint, s double, m2 double"


class _Dense:
    """Dense arrays over a local dictionary of keys (null is a key of its own): rows, values, their
    sum, and the sum of their squared distances from the mean."""

    def __init__(self) -> None:
        self.keys = pa.array([], pa.string())
        self.sums: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]

    def add(self, keys: pa.Array, values: list[np.ndarray]) -> None:
        both = pa.concat_arrays([self.keys, keys]).dictionary_encode(null_encoding="encode")
        codes, size = both.indices.to_numpy(zero_copy_only=False), len(both.dictionary)
        rows, n, s, m2 = (np.concatenate([kept, new]) for kept, new in zip(self.sums, values, strict=True))
        total = lambda w: np.bincount(codes, weights=w, minlength=size)
        # (counts are exact as doubles: a task has fewer than 2^53 rows)
        n_of, s_of = total(n), total(s)
        mean = s_of / np.maximum(n_of, 1)
        off = s / np.maximum(n, 1) - mean[codes]
        self.sums = [total(rows).astype(np.int64), n_of.astype(np.int64), s_of, total(m2 + n * off * off)]
        self.keys = both.dictionary

    def __len__(self) -> int:
        return len(self.keys)


def _one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _partials(n_fields: int, blocks: int, chunk: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = [_Dense() for _ in range(n_fields)]
        held: list[pa.RecordBatch] = []
        rows = 0

        def absorb() -> None:
            nonlocal held, rows
            if not held:
                return
            t = pa.Table.from_batches(held)
            held, rows = [], 0
            v = _one(t.column(n_fields)).to_numpy(zero_copy_only=False).astype(np.float64)
            there = ~np.isnan(v)
            v = np.where(there, v, 0.0)
            values = [np.ones(len(v), np.int64), there.astype(np.int64), v, np.zeros(len(v))]
            for f in range(n_fields):
                dense[f].add(_one(t.column(f)), values)

        def blocks_of(f: int) -> Iterator[pa.RecordBatch]:
            d = dense[f]
            if not len(d):
                return
            keys = np.array(d.keys.to_pylist(), dtype=object)
            at = (pd.util.hash_array(keys, categorize=False) % blocks).astype(np.int32)
            order = np.argsort(at, kind="stable")
            numbers, starts = np.unique(at[order], return_index=True)
            offsets = pa.array(np.append(starts, len(order)), pa.int32())
            cut = lambda a: pa.ListArray.from_arrays(offsets, a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(numbers), f, np.int32)), pa.array(numbers), cut(d.keys.take(pa.array(order)))] + [cut(pa.array(x[order])) for x in d.sums],
                names=["field", "block", "keys", "n_rows", "n", "s", "m2"],
            )
            dense[f] = _Dense()

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= chunk:
                absorb()
                for f in range(n_fields):
                    if len(dense[f]) >= most:
                        yield from blocks_of(f)
        absorb()
        for f in range(n_fields):
            yield from blocks_of(f)

    return run


def _merge(n_fields: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = [_Dense() for _ in range(n_fields)]
        held: list[list] = [[] for _ in range(n_fields)]
        waiting = [0] * n_fields

        def absorb(f: int) -> None:
            if held[f]:
                keys = pa.concat_arrays([x[0] for x in held[f]])
                dense[f].add(keys, [np.concatenate([x[1][i] for x in held[f]]) for i in range(4)])
                held[f], waiting[f] = [], 0

        for b in batches:
            fields = b.column(0).to_numpy()
            for f in np.unique(fields):
                part = b.filter(pa.array(fields == f))
                keys = part.column(2).flatten()
                held[f].append((keys, [part.column(3 + i).flatten().to_numpy(zero_copy_only=False) for i in range(4)]))
                waiting[f] += len(keys)
                if waiting[f] >= max(chunk, len(dense[f])):
                    absorb(f)
        for f in range(n_fields):
            absorb(f)
            d = dense[f]
            for at in range(0, len(d), 100_000):
                x = slice(at, at + 100_000)
                keys = d.keys[x]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), f, np.int32)), keys] + [pa.array(v[x]) for v in d.sums], names=["field", "key_value", "n_rows", "n", "s", "m2"])

    return run


def key_sums(df: DataFrame, keys: Sequence[str], value: str, blocks: int | None = None, chunk: int = 500_000, most: int = 500_000) -> DataFrame:
    """Rows, non-null values, their sum and sum of squared distances from the mean (``m2``) for
    each key of each field.

    ``keys`` are the key columns, each aggregated by itself; the result has a row per field and
    key, with the null key as a row of its own. ``chunk`` rows are encoded at a time and a task
    gives its arrays away once they hold ``most`` keys, so a task's memory does not follow the
    number of keys. ``blocks`` (default: four per shuffle partition) only spreads the keys.
    """
    blocks = blocks or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = df.select(*[F.col(f"`{k}`").cast("string").alias(f"k{i}") for i, k in enumerate(keys)], F.col(f"`{value}`").cast("double").alias("v"))
    partial = narrow.mapInArrow(_partials(len(keys), blocks, chunk, most), PARTIAL)
    merged = partial.repartition("field", "block").mapInArrow(_merge(len(keys), chunk), MERGED)
    names = F.element_at(F.array(*[F.lit(k) for k in keys]), F.col("field") + 1)
    return merged.withColumn("field", names)


def key_stats(df: DataFrame, keys: Sequence[str], value: str, **how) -> DataFrame:
    """``field, key_value, n_rows, n_values, mean, stddev`` (population) for every key.

    Defined results: a null key gives no row; a null (or NaN) value counts in ``n_rows`` only; a
    key without any value has null mean and deviation; a single value has deviation 0; an empty
    table gives no rows; further columns, also ones named like the result's, are ignored.
    """
    return _present(key_sums(df, keys, value, **how))


def _present(sums: DataFrame) -> DataFrame:
    n = F.col("n")
    some = lambda c: F.when(n > 0, c)
    return sums.filter(F.col("key_value").isNotNull()).select("field", "key_value", "n_rows", n.alias("n_values"), some(F.col("s") / n).alias("mean"), some(F.sqrt(F.col("m2") / n)).alias("stddev"))


def heavy_keys(df: DataFrame, keys: Sequence[str], value: str, share: float = 0.025, **how) -> DataFrame:
    """The rows of ``key_stats`` whose key holds at least ``share`` of all rows of ``df``.

    All rows count, also those whose key is null; an empty table has no heavy keys. The number
    of rows comes from the sums of the first field, whose shuffled blocks are read again; the
    table itself is read once.
    """
    sums = key_sums(df, keys, value, **how)
    total: Column = sums.filter(F.col("field") == keys[0]).agg(F.sum("n_rows")).scalar()
    return _present(sums).filter(F.col("n_rows") >= F.lit(Decimal(str(share))) * total)
