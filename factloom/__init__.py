"""A Spark-native feature engine: declared features compile to DataFrame plans of facts."""

from factloom.plans import aggregate as agg
from factloom.plans.features import (
    AggregationFeature,
    AggregationFeatureSet,
    BasicFeatureSet,
    Feature,
    FeatureContext,
    FeatureSet,
    FeatureStub,
    Metadata,
    MetadataSet,
    PivotFeatureSet,
    QueryFeatureSet,
    eavt,
    general,
)
from factloom.plans.source import From, Join, from_, join, join_multi, left_join, lift_join
from factloom.ranges import MapRange, MinMaxRange, SetRange
from factloom.record import Record, Schema
from factloom.sources.data import DataFrameSource, ParquetSource, Partition, Partitions, TextSource, View, decode_leniently
from factloom.types import FeatureType, ValueType

__all__ = [
    "AggregationFeature", "AggregationFeatureSet", "BasicFeatureSet", "DataFrameSource", "Feature", "FeatureContext", "FeatureSet", "FeatureStub", "FeatureType",
    "From", "Join", "MapRange", "Metadata", "MetadataSet", "MinMaxRange", "ParquetSource", "Partition", "Partitions", "PivotFeatureSet", "QueryFeatureSet", "Record",
    "Schema", "SetRange", "TextSource", "ValueType", "View", "agg", "decode_leniently", "eavt", "from_", "general", "join", "join_multi", "left_join", "lift_join",
]
