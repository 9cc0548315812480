"""Short keys for whole rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_key(columns: Sequence[str]) -> tuple[Column, Column]:
    """128 bits that tell rows apart by the given columns, null being a value like any other.

    Two chains of 64-bit hashes from different starts: among n different rows, the chance that
    any two agree in both is about n^2 / 2^129 (3e-16 for a hundred billion rows).
    """
    # the hash passes over nulls, so each column is followed by whether it is one
    parts = [x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)
