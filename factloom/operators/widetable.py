"""Entity-attribute-value rows into one typed row per entity, with its values that fit no type.

Facts are reduced to the latest fitting one per entity and attribute, and to the number of
misfits, before they are shuffled by entity, so an entity brings at most one row per attribute
into its task. Tasks get the rows sorted by entity and attribute number and stream them into
columnar batch builders: per attribute one typed buffer and one validity mask, filled by
scattering, and beside them a list of the misfits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.shared import bounded_rows

# The Spark and Arrow types of the declared types.
SPARK_TYPES = {"integral": "bigint", "decimal": "decimal(38,18)", "floatingpoint": "double", "date": "date", "time": "timestamp", "bool": "boolean", "str": "string"}
ARROW_TYPES = {
    "integral": pa.int64(), "decimal": pa.decimal128(38, 18), "floatingpoint": pa.float64(), "date": pa.date32(), "time": pa.timestamp("us", "UTC"), "bool": pa.bool_(), "str": pa.string(),
}
TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}[+-]\d{2}:\d{2}$"
DECIMAL = r"^[+-]?[0-9]+(\.[0-9]+)?(E[+-]?[0-9]+)?$"
# Marks the text of a decimal that decimal(38,18) does not hold exactly.
_BEYOND = "~"
_MISFITS = "array<struct<attribute: string, n_values: bigint>>"
_TEXTS = "map<string, string>"


def _decimal(v: Column) -> Column:
    """The value in decimal(38,18), or its own text behind ``_BEYOND`` where digits would be lost.

    (Texts with large exponents are not cast: the cast would write out all their zeros.)
    """
    exponent = F.coalesce(F.regexp_extract(v, r"E([+-]?[0-9]{1,9})$", 1).try_cast("int"), F.when(v.contains("E"), 10**6).otherwise(0))
    digits = F.length(F.rtrim(F.regexp_extract(v, r"\.([0-9]+)", 1), F.lit("0")))
    exact = exponent.between(-60, 60) & (digits - exponent <= 18)
    return F.coalesce(F.when(exact, v).try_cast("decimal(38,18)").cast("string"), F.concat(F.lit(_BEYOND), v))


def canonical(value: Column, value_type: Column) -> Column:
    """The text (without outer blanks) in the one spelling the builders read; null if it is not
    of the declared type."""
    v = value
    moment = F.when(
        v.rlike(TIME) & (F.substring(v, 12, 2) <= "23") & (F.substring(v, 15, 2) <= "59") & (F.substring(v, 18, 2) <= "59") & (F.substring(v, -5, 2) <= "23") & (F.substring(v, -2, 2) <= "59"),
        F.unix_millis(F.try_make_timestamp(*[F.substring(v, a, n).cast("int") for a, n in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2))], F.substring(v, 18, 6).cast("decimal(16,6)"), F.lit("UTC")))
        - (F.substring(v, -5, 2).cast("int") * 60 + F.substring(v, -2, 2).cast("int")) * F.when(F.substring(v, -6, 1) == "-", -60_000).otherwise(60_000),
    )
    return (
        F.when(value_type == "str", v)
        .when(value_type == "integral", F.when(v.rlike(r"^[+-]?[0-9]+$"), v.try_cast("bigint").cast("string")))
        .when(value_type == "floatingpoint", F.when(v.rlike(DECIMAL) | v.rlike(r"^(NaN|[+-]?Infinity)$"), v.try_cast("double").cast("string")))
        .when(value_type == "decimal", F.when(v.rlike(DECIMAL), _decimal(v)))
        .when(value_type == "bool", F.when(F.lower(v).isin("true", "false"), F.lower(v)))
        .when(value_type == "date", F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), v.try_cast("date").cast("string")))
        .when(value_type == "time", moment.cast("string"))
    )


def declarations(metadata: DataFrame) -> DataFrame:
    """``__declared, value_type, __key`` of the attributes; of one name spelled twice, the first in order."""
    named = metadata.filter(F.col("attribute").isNotNull()).groupBy(F.lower(F.trim("attribute")).alias("__key"))
    return named.agg(F.min(F.struct("attribute", "value_type")).alias("__m")).select(F.col("__m.attribute").alias("__declared"), F.col("__m.value_type").alias("value_type"), "__key")


def _cast(texts: pa.Array, value_type: str) -> pa.Array:
    if value_type == "time":
        return pc.multiply(texts.cast(pa.int64()), 1000).cast(ARROW_TYPES[value_type])
    if value_type == "decimal":
        texts = pc.if_else(pc.starts_with(texts, _BEYOND), None, texts)
    return texts.cast(ARROW_TYPES[value_type])


def _build(names: Sequence[str], types: Sequence[str]):
    decimals = np.array([t == "decimal" for t in types] + [False])
    all_names = pa.array([*names, None], pa.string())

    def per_entity(row: np.ndarray, hit: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
        """Where the lists of entities begin among the rows ``hit``, and those rows."""
        at = np.flatnonzero(hit)
        return pa.array(np.searchsorted(row[at], np.arange(n + 1)).astype(np.int32)), pa.array(at)

    def rows_of(t: pa.Table) -> pa.RecordBatch:
        entity = t.column(0).combine_chunks().dictionary_encode()
        row = entity.indices.to_numpy(zero_copy_only=False)
        index, text, bad = t.column(1).to_numpy(), t.column(2).combine_chunks(), t.column(3).to_numpy()
        n, there = len(entity.dictionary), text.is_valid().to_numpy(zero_copy_only=False)
        # one sort brings the cells of each attribute together; a slice of it is a column
        cells = np.flatnonzero(there & (index >= 0))
        cells = cells[np.argsort(index[cells], kind="stable")]
        starts = np.searchsorted(index[cells], np.arange(len(types) + 1))
        columns = [entity.dictionary]
        for i, value_type in enumerate(types):
            mine = cells[starts[i] : starts[i + 1]]
            if len(mine):
                # an attribute's validity mask: -1 where the entity has no value
                place = np.full(n, -1, np.int64)
                place[row[mine]] = np.arange(len(mine))
                columns.append(_cast(text.take(pa.array(mine)), value_type).take(pa.array(place, mask=place < 0)))
            else:
                columns.append(pa.nulls(n, ARROW_TYPES[value_type]))
        offsets, at = per_entity(row, bad > 0, n)
        which = lambda a: all_names.take(pa.array(index[a.to_numpy()]))
        columns.append(pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([which(at), pa.array(bad[at.to_numpy()])], ["attribute", "n_values"])))
        beyond = there & decimals[index] & pc.fill_null(pc.starts_with(text, _BEYOND), False).to_numpy(zero_copy_only=False)
        offsets, at = per_entity(row, beyond, n)
        columns.append(pa.MapArray.from_arrays(offsets, which(at), pc.utf8_slice_codeunits(text.take(at), 1)))
        return pa.RecordBatch.from_arrays(columns, names=["entity", *[f"a{i}" for i in range(len(types))], "misfits", "beyond"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            # the last entity may go on in the next batch
            whole = pc.index(t.column(0), t.column(0)[t.num_rows - 1]).as_py()
            if whole:
                yield rows_of(t.slice(0, whole))
            held = t.slice(whole)
        if held is not None and held.num_rows:
            yield rows_of(held)

    return run


def typed_rows(facts: DataFrame, metadata: DataFrame, utc_ms: str = "utc_ms", tie: str = "fact_id", most: int = 2_000, blank: str = " ") -> tuple[DataFrame, list[str]]:
    """One row per entity: ``entity``, a typed column ``a0``, ``a1``, ... per declared attribute,
    ``misfits`` and ``beyond``; and the attributes' names in the order of the columns.

    ``misfits`` lists the attributes that have values of another type, with the number of these
    values: null and ``\\N`` fit every type, an empty value fits ``str`` only. ``beyond`` maps
    the attributes whose decimal has digits that decimal(38,18) does not hold to its text.
    ``utc_ms`` and ``tie`` say which fact is the latest; see ``wide_table``.
    """
    listed = bounded_rows(declarations(metadata).filter(F.col("value_type").isin(*SPARK_TYPES)).select("__declared", "value_type", "__key").orderBy("__declared"), most, "attributes")
    names, types = [r[0] for r in listed], [r[1] for r in listed]
    spark = facts.sparkSession
    number = spark.createDataFrame([(r[2], i, r[1]) for i, r in enumerate(listed)], "__key string, a int, value_type string")
    keep = facts.select("entity", F.lower(F.btrim(F.col("attribute"), F.lit(" \t\r\n "))).alias("__key"), "value", F.col(utc_ms).alias("__ms"), F.col(tie).alias("__tie"))
    # (the table of attributes is bounded by ``most``)
    rows = keep.filter(F.col("entity").isNotNull()).join(F.broadcast(number), "__key", "left").withColumn("text", F.when(F.col("value") != "\\N", F.btrim(F.col("value"), F.lit(blank))))
    rows = rows.withColumn("typed", canonical(F.col("text"), F.col("value_type")))
    known = F.col("a").isNotNull()
    fits = known & (F.col("text").isNull() | F.col("typed").isNotNull())
    rank = F.struct(F.coalesce(F.col("__ms"), F.lit(-(2**62))), F.col("__tie"), F.col("typed"))
    reduced = rows.groupBy("entity", F.coalesce("a", F.lit(-1)).alias("a")).agg(F.max(F.when(fits, rank)).alias("x"), F.count_if(known & ~fits).alias("bad"))
    sorted_rows = reduced.select("entity", "a", F.col("x.typed").alias("typed"), "bad").repartition("entity").sortWithinPartitions("entity", "a")
    schema = "entity string" + "".join(f", a{i} {SPARK_TYPES[t]}" for i, t in enumerate(types)) + f", misfits {_MISFITS}, beyond {_TEXTS}"
    return sorted_rows.mapInArrow(_build(names, types), schema), names


def misfits(facts: DataFrame, metadata: DataFrame, **how) -> DataFrame:
    """``entity, attribute, n_values``: entities and declared attributes with values that do not
    fit the declared type, as the builders report them beside the cells. Facts without an entity
    have no row."""
    built, _ = typed_rows(facts, metadata, **how)
    return built.select("entity", F.inline("misfits"))


def wide_table(facts: DataFrame, metadata: DataFrame, beyond: str | None = None, **how) -> DataFrame:
    """One row per entity with one typed column per declared attribute.

    A cell holds the value of the latest fact that fits the declared type; of facts of one
    instant that with the largest ``tie``. Facts without a readable time are the earliest. A
    null or ``\\N`` fits and makes the cell null. An entity with only undeclared attributes or
    misfitting values has a row of nulls. An attribute named like the entity's column gets the
    prefix ``attribute_``. A decimal with more digits than decimal(38,18) holds has a null cell;
    ``beyond`` names a column that maps such attributes to the exact text. More than ``most``
    attributes raise an error.
    """
    built, names = typed_rows(facts, metadata, **how)
    columns = ["entity", *[f"attribute_{n}" if n.lower() == "entity" else n for n in names]]
    cells = [F.col("entity"), *[F.col(f"a{i}") for i in range(len(names))]]
    return built.select(*cells, "beyond").toDF(*columns, beyond) if beyond else built.select(*cells).toDF(*columns)
