"""Row-wise feature sets over Structured Streaming; an extension, aggregation sets stay in batches.

A feature set compiles to a projection, which is the same plan on a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from factloom.plans.features import FeatureContext, FeatureSet, eavt
from factloom.plans.source import from_
from factloom.sources.data import DataFrameSource


def facts(stream: DataFrame, features: FeatureSet, context: FeatureContext) -> DataFrame:
    """Encoded facts of a stream of source records (single-table sources)."""
    df = features.source.bind(from_(DataFrameSource(stream))).load()
    return eavt(features.generate(df, context, encoded=True))


def start(stream: DataFrame, features: FeatureSet, context: FeatureContext, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the facts as Parquet, exactly once per source record; runs what is there and stops."""
    out = facts(stream, features, context).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start()
