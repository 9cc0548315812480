"""Queries of the text problems over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import leakage, packing, truncation


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(_table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(packing.containers(_table(spark, d, "documents")))


def p8_valid(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document is whole: divided only where it is longer than a container, its parts
    without gap, and every part but an empty one in a container."""
    return packing.wholeness(packing.containers(_table(spark, d, "documents")))


def p8_tight(spark: SparkSession, d: str) -> DataFrame:
    """Whether no container holds more than fits, and whether there are at most 2 % more (and one)
    than the tokens would fill without gap."""
    f = packing.fill(packing.containers(_table(spark, d, "documents")))
    return f.selectExpr("fullest <= 2048 AS within_capacity", "containers <= 1.02 * tokens / 2048 + 1 AS filled")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p9_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    items = _table(spark, d, "eval_items")
    return leakage.leaked_items(leakage.leaks(_table(spark, d, "documents"), items), items)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(_table(spark, d, "documents"))


def p10_by_source(spark: SparkSession, d: str) -> DataFrame:
    return truncation.by_source(_table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p8_containers, p8_fill, p8_valid, p8_tight, p9_found, p9_leaked_items, p10_found, p10_by_source)}
_LEAKS = """
    WITH texts AS (SELECT doc_id AS id, text, 'd' AS kind FROM documents UNION ALL SELECT item_id, text, 'i' FROM eval_items),
    w AS (SELECT id, kind, regexp_extract_all(lower(regexp_replace(text, '-(\r\n|\n|\r)', '', 'g')), '[\\p{L}\\p{N}]+') AS w FROM texts),
    runs AS (SELECT id, kind, hash(array_to_string(w[k:k + 14], ' ')) AS run FROM (SELECT id, kind, w, unnest(range(1, len(w) - 13)) AS k FROM w WHERE len(w) >= 15)),
    found AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM runs d JOIN runs i ON d.run = i.run WHERE d.kind = 'd' AND i.kind = 'i')"""

ORACLES = {
    "p9_found": f"{_LEAKS} SELECT doc_id, item_id FROM found",
    "p9_leaked_items": f"{_LEAKS} SELECT item_id, CAST(count(*) AS BIGINT) AS n_documents, any_value(suite) AS suite FROM found JOIN eval_items USING (item_id) GROUP BY item_id",
    "p8_valid": "SELECT doc_id, true AS undivided, true AS gapless, true AS placed FROM documents",
    "p8_tight": "SELECT true AS within_capacity, true AS filled",
    "p10_found": truncation.twin()["truncated"],
    "p10_by_source": truncation.twin()["by_source"],
}
