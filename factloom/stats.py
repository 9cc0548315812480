"""Row counters by name. They are opt-in: a counter in a plan keeps filters above it from being
pushed below it."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

log = logging.getLogger("factloom.counters")


def _rows(seen: Observation) -> int:
    try:
        return int(seen.get["rows"])
    except Py4JJavaError:
        # a plan that Spark found to be empty has no metrics left in it
        return 0


class Stats:
    def __init__(self) -> None:
        self.counters: list[tuple[str, Observation]] = []

    def count(self, df: DataFrame, name: str) -> DataFrame:
        seen = Observation()
        self.counters.append((name, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def values(self) -> list[tuple[str, int]]:
        """Rows by counter, in plan order; to be read after an action."""
        return [(name, _rows(o)) for name, o in self.counters]

    def write_log(self) -> list[str]:
        try:
            lines = ["Feature job counters:", *[f"    {name:<30} {n:>10d}" for name, n in self.values()]]
        except Exception as e:  # counters never fail a job
            log.warning("Counters are not available: %s", e)
            return []
        for line in lines:
            log.info(line)
        return lines
