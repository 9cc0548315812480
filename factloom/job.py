"""Jobs: feature sets in parallel groups that run one after another, committed once at the end."""

from __future__ import annotations

import logging
import sys
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from factloom import sinks
from factloom.plans.features import AggregationFeatureSet, FeatureContext, FeatureSet
from factloom.plans.source import BoundSource
from factloom.record import session
from factloom.stats import Stats

log = logging.getLogger("factloom.job")


@dataclass(frozen=True)
class FeatureJobConfig:
    source: BoundSource
    sink: sinks.FeatureSink
    context: FeatureContext


@dataclass(frozen=True)
class FeatureSetExecution:
    config: FeatureJobConfig
    features: FeatureSet | AggregationFeatureSet

    def run(self, stats: Stats | None = None) -> set[str]:
        df = self.config.source.load(stats)
        facts = self.features.generate(df, self.config.context, encoded=True)
        return self.config.sink.write(facts, self.features, stats)


@dataclass(frozen=True)
class FeatureSetExecutions:
    """Groups in sequence, the executions of a group in parallel."""

    groups: tuple[tuple[FeatureSetExecution, ...], ...]

    @staticmethod
    def of(*executions: FeatureSetExecution) -> FeatureSetExecutions:
        return FeatureSetExecutions((executions,))

    def and_then(self, *executions: FeatureSetExecution) -> FeatureSetExecutions:
        return FeatureSetExecutions((*self.groups, executions))

    def run(self, stats: Stats | None = None) -> set[str]:
        spark, paths = session(), set()
        for group in self.groups:

            def one(i: int, e: FeatureSetExecution) -> set[str]:
                # a pool of its own each, so that a FAIR scheduler shares the cluster
                spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"features-{i}")
                return e.run(stats)

            with ThreadPoolExecutor(max(1, len(group))) as pool:
                for written in pool.map(one, range(len(group)), group):
                    paths |= written
        return paths


class SimpleFeatureJob:
    """Runs, commits, and reports a status: 0, or the exit code of a refused write or commit."""

    @staticmethod
    def generate(config: FeatureJobConfig, features: FeatureSet | AggregationFeatureSet, stats: Stats | None = None) -> int:
        return SimpleFeatureJob.run(FeatureSetExecutions.of(FeatureSetExecution(config, features)), stats)

    @staticmethod
    def run(executions: FeatureSetExecutions, stats: Stats | None = None) -> int:
        try:
            sinks.commit(executions.run(stats))
        except (sinks.AlreadyCommitted, sinks.AttemptedWriteToCommitted) as e:
            log.error("%s", e)
            return e.exit_code
        finally:
            if stats:
                stats.write_log()
        return 0


def main(executions: FeatureSetExecutions) -> None:
    sys.exit(SimpleFeatureJob.run(executions))
