"""Value types, statistical types, their legal combinations, and value encodings."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME_STRUCT = T.StructType([T.StructField("millis", T.LongType()), T.StructField("off_h", T.IntegerType()), T.StructField("off_m", T.IntegerType())])
NULL_TEXT = "\\N"


class ValueType(Enum):
    """The closed set of value types: JSON name, PSV name, carrier column, Spark type."""

    INTEGRAL = ("integral", "int", "v_long", T.LongType())
    DECIMAL = ("decimal", "bigdecimal", "v_dec", T.DecimalType(38, 18))
    FLOATING_POINT = ("floatingpoint", "double", "v_dbl", T.DoubleType())
    STR = ("string", "string", "v_str", T.StringType())
    DATE = ("date", "date", "v_date", T.DateType())
    TIME = ("time", "datetime", "v_time", TIME_STRUCT)
    BOOL = ("bool", "bool", "v_bool", T.BooleanType())

    def __init__(self, json_name: str, psv_name: str, carrier: str, spark_type: T.DataType):
        self.json_name, self.psv_name, self.carrier, self.spark_type = json_name, psv_name, carrier, spark_type

    @property
    def ordered(self) -> bool:
        return self is not ValueType.BOOL


class FeatureType(Enum):
    CONTINUOUS = ("continuous", "continuous")
    DISCRETE = ("discrete", "continuous")
    ORDINAL = ("ordinal", "categorical")
    NOMINAL = ("nominal", "categorical")
    INSTANT = ("instant", "datetime")

    def __init__(self, json_name: str, psv_name: str):
        self.json_name, self.psv_name = json_name, psv_name


_V, _F = ValueType, FeatureType
CONFORMS: frozenset[tuple[FeatureType, ValueType]] = frozenset(
    [(_F.CONTINUOUS, v) for v in (_V.INTEGRAL, _V.DECIMAL, _V.FLOATING_POINT)]
    + [(_F.DISCRETE, _V.INTEGRAL)]
    + [(_F.ORDINAL, v) for v in (_V.INTEGRAL, _V.DECIMAL, _V.FLOATING_POINT, _V.STR)]
    + [(_F.NOMINAL, v) for v in (_V.INTEGRAL, _V.STR, _V.BOOL)]
    + [(_F.INSTANT, v) for v in (_V.DATE, _V.TIME)]
)


def conforms(feature_type: FeatureType, value_type: ValueType) -> bool:
    return (feature_type, value_type) in CONFORMS


def value_type_of(data_type: T.DataType) -> ValueType:
    """The value type a Spark type lifts to; only wider integers and doubles are implied."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return ValueType.INTEGRAL
    if isinstance(data_type, T.DecimalType):
        return ValueType.DECIMAL
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return ValueType.FLOATING_POINT
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return ValueType.STR
    if isinstance(data_type, T.DateType):
        return ValueType.DATE
    if isinstance(data_type, T.BooleanType):
        return ValueType.BOOL
    if isinstance(data_type, T.StructType) and [f.name for f in data_type] == [f.name for f in TIME_STRUCT]:
        return ValueType.TIME
    raise TypeError(f"no value type for {data_type.simpleString()}")


def lift(value: Column, value_type: ValueType) -> Column:
    return value if value_type is ValueType.TIME else value.cast(value_type.spark_type)


def encode(value: Column, value_type: ValueType) -> Column:
    """The text of a value in fact tables; null of any type is ``\\N``."""
    from factloom.functions.datetimes import rfc3339

    if value_type is ValueType.TIME:
        text = rfc3339(value)
    elif value_type is ValueType.DATE:
        text = F.date_format(value, "yyyy-MM-dd")
    elif value_type is ValueType.DECIMAL:
        plain = value.cast("string")
        text = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(NULL_TEXT))
