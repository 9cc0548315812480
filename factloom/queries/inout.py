"""Queries that go through sources, sinks, jobs, metadata and times as authors use them.

What they write goes to the application's part of the shared folder and is read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import FeatureContext, From, Schema, agg, from_
from factloom import metadata as md
from factloom import sinks
from factloom.functions import datetimes as dt
from factloom.job import FeatureJobConfig, FeatureSetExecution, FeatureSetExecutions, SimpleFeatureJob
from factloom.plans.features import Feature, FeatureStub, MetadataSet, general
from factloom.plans.source import lift_join
from factloom.queries.reference import CUSTOMER, LINEITEM, NATION, ORDERS, _agg, _builder, _customer, _set, bound, ds, query, shown
from factloom.ranges import MapRange, MinMaxRange, SetRange
from factloom.shared import fresh_path, table
from factloom.sources.data import ParquetSource, Partition, Partitions, TextSource, decode_leniently
from factloom.stats import Stats
from factloom.types import FeatureType as FT
from factloom.types import ValueType as VT

CONTEXT = FeatureContext(1_420_070_400_000)  # 2015-01-01 UTC
FACTS = Schema("Fact", "entity string, attribute string, value string, time string", optional=("value",))
DAY = ("2015", "01", "01")
# Fixed value: DuckDB text of the customers' facts, as the sinks write them.
_CUSTOMER_FACTS = """
    SELECT CAST(c_custkey AS VARCHAR) AS entity, 'segment' AS attribute, c_mktsegment AS value, '2015-01-01' AS time FROM customer
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'nation', CAST(c_nationkey AS VARCHAR), '2015-01-01' FROM customer
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'note', CASE c_mktsegment WHEN 'BUILDING' THEN '' WHEN 'MACHINERY' THEN NULL ELSE '"' END, '2015-01-01' FROM customer"""


def _customers():
    src = From(CUSTOMER)
    b = _builder(src, _customer)
    note = lambda c: F.when(c.c_mktsegment == "BUILDING", "").when(c.c_mktsegment != "MACHINERY", '"')
    return _set(
        src,
        _customer,
        b.select(lambda c: c.c_mktsegment).as_feature(FT.NOMINAL, "segment", SetRange("BUILDING", "MACHINERY", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD"), "Segment"),
        b.select(lambda c: c.c_nationkey).as_feature(FT.ORDINAL, "nation", MinMaxRange(0, 24), "Nation"),
        b.select(note).as_feature(FT.NOMINAL, "note", MapRange(("", "none"), ('"', "a quote")), "Note"),
    )


def _config(spark: SparkSession, d: str, sink) -> FeatureJobConfig:
    return FeatureJobConfig(From(CUSTOMER).bind(from_(ds(spark, d, CUSTOMER))), sink, CONTEXT)


def _text(spark: SparkSession, partition=None, **how) -> sinks.TextSink:
    return sinks.TextSink("features", fresh_path(spark, "text"), f"t_{uuid.uuid4().hex}", partition or sinks.DerivedSinkPartition.eavt_by_day(), **how)


def _run(executions: FeatureSetExecutions) -> None:
    status = SimpleFeatureJob.run(executions)
    if status:
        raise RuntimeError(f"job ended with {status}")


# 1. Sinks, sources and jobs


@query(f"""{_CUSTOMER_FACTS}
    UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'orders', CAST(count(*) AS VARCHAR), '2015-01-01' FROM orders GROUP BY o_custkey""")
def q_job_text_sink_to_source(spark, d):
    """Two sets of one job, one after the other, into delimited text by derived day; read as text."""
    sink = _text(spark)
    src, key = From(ORDERS), lambda o: o.o_custkey.cast("string")
    orders = _agg(src, key, _builder(src, key).select(agg.size()).as_feature(FT.DISCRETE, "orders", "Orders"))
    config = FeatureJobConfig(src.bind(from_(ds(spark, d, ORDERS))), sink, CONTEXT)
    _run(FeatureSetExecutions.of(FeatureSetExecution(_config(spark, d, sink), _customers())).and_then(FeatureSetExecution(config, orders)))
    return TextSource(sink.path, FACTS, Partitions(Partition.by_day(), DAY)).load()


@query(_CUSTOMER_FACTS)
def q_job_parquet_sink_to_source(spark, d):
    """Parquet in a fixed partition, its empty strings, nulls and quotes read back as written."""
    path = fresh_path(spark, "parquet")
    sink = sinks.ParquetSink("features", f"p_{uuid.uuid4().hex}", path, sinks.FixedSinkPartition.by_day("2015-01-01"))
    _run(FeatureSetExecutions.of(FeatureSetExecution(_config(spark, d, sink), _customers())))
    encoded = ParquetSource(path, FACTS, Partitions(Partition.by_day(), DAY)).load()
    return encoded.withColumn("value", F.when(F.col("value") != "\\N", F.col("value")))


@query(f"SELECT *, '2015' AS year, '01' AS month, '01' AS day FROM ({_CUSTOMER_FACTS})")
def q_sink_table(spark, d):
    """The table over a text sink: by partition, with empty strings that stay empty."""
    sink = _text(spark, sinks.FixedSinkPartition.by_day("2015-01-01"))
    _run(FeatureSetExecutions.of(FeatureSetExecution(_config(spark, d, sink), _customers())))
    return spark.table(f"features.{sink.table}").filter("year = '2015' AND month = '01'")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS entity, 'key' AS attribute, o_orderpriority || '/' || o_orderstatus AS value, '2015-01-01' AS time FROM orders")
def q_delimiter_conflict(spark, d):
    """Values that hold the delimiter, replaced by a conflict handler."""
    src, key = From(ORDERS), lambda o: o.o_orderkey.cast("string")
    s = _set(src, key, _builder(src, key).select(lambda o: F.concat(o.o_orderpriority, F.lit("|"), o.o_orderstatus)).as_feature(FT.NOMINAL, "key", "Key"))
    sink = _text(spark, conflict=lambda column, text, delimiter: F.replace(text, F.lit(delimiter), F.lit("/")))
    _run(FeatureSetExecutions.of(FeatureSetExecution(FeatureJobConfig(src.bind(from_(ds(spark, d, ORDERS))), sink, CONTEXT), s)))
    return TextSource(sink.path, FACTS, Partitions(Partition.by_day(), DAY)).load()


@query("""
    SELECT c_mktsegment AS segment, CAST(c_custkey AS VARCHAR) AS entity, 'balance_known' AS attribute, CASE WHEN c_acctbal < 0 THEN 'false' ELSE 'true' END AS value FROM customer""")
def q_sink_by_field(spark, d):
    """A sink with an encoder of its own, partitioned by one of its fields; partitions by glob."""
    src = From(CUSTOMER)
    s = _set(src, _customer, _builder(src, _customer).select(lambda c: F.concat_ws("/", c.c_mktsegment, c.c_acctbal >= 0)).as_feature(FT.NOMINAL, "balance_known", "Known"))

    def encoder(facts: DataFrame) -> DataFrame:
        return facts.select(F.substring_index("value", "/", 1).alias("segment"), "entity", "attribute", F.substring_index("value", "/", -1).alias("value"))

    kind = Partition.by_field("kind")
    sink = _text(spark, sinks.DerivedSinkPartition(kind, (lambda df: df["segment"],)), encoder=encoder)
    _run(FeatureSetExecutions.of(FeatureSetExecution(FeatureJobConfig(src.bind(from_(ds(spark, d, CUSTOMER))), sink, CONTEXT), s)))
    return TextSource(sink.path, Schema("Own", "segment string, entity string, attribute string, value string"), Partitions(kind, "*")).load()


@query("""
    SELECT * FROM (VALUES ('first run', 0, 3), ('committed', 1, 3), ('run again', -3, 3), ('commit again', -2, 3)) t(step, status, facts_per_customer)""")
def q_commit_protocol(spark, d):
    """What runs and commits of a committed partition answer, and that they change nothing."""
    sink = _text(spark)
    one = FeatureSetExecutions.of(FeatureSetExecution(_config(spark, d, sink), _customers()))
    path, customers = f"{sink.path}/{Partition.by_day().pattern % DAY}", table(spark, d, "customer").count()
    steps = []

    def done(step: str, status: int) -> None:
        steps.append((step, status, spark.read.text(path).count() // customers))

    done("first run", SimpleFeatureJob.run(one))
    done("committed", int(sinks.is_committed(path)))
    done("run again", SimpleFeatureJob.run(one))
    try:
        sinks.commit([path])
    except sinks.AlreadyCommitted as e:
        done("commit again", e.exit_code)
    return spark.createDataFrame(steps, "step string, status int, facts_per_customer int")


@query("""
    SELECT 'load.dataframe' AS counter, count(*) AS n FROM customer UNION ALL SELECT 'write.text', 3 * count(*) FROM customer""")
def q_job_counters(spark, d):
    stats = Stats()
    sink = _text(spark)
    SimpleFeatureJob.run(FeatureSetExecutions.of(FeatureSetExecution(_config(spark, d, sink), _customers())), stats)
    return spark.createDataFrame(stats.values(), "counter string, n bigint")


@query("""
    SELECT * FROM (VALUES (0, 'segment', 'string', 'nominal', 5), (0, 'nation', 'integral', 'ordinal', 2), (0, 'note', 'string', 'nominal', 2),
        (1, 'segment', 'string', 'nominal', 5), (1, 'nation', 'integral', 'ordinal', 2), (1, 'note', 'string', 'nominal', 2),
        (2, 'stub', 'bigdecimal', 'continuous', 0)) t(version, name, value_type, feature_type, n_range)""")
def q_metadata(spark, d):
    """Metadata written by a sink beside its facts (version 1), as a flat list (version 0), and the
    lines of a stub (2), each read back."""
    sink = sinks.MetadataSink(_text(spark), md.Json1)
    s = _customers()
    _run(FeatureSetExecutions.of(FeatureSetExecution(_config(spark, d, sink), s)))
    written = sinks.Files(spark).get(f"{sink.underlying.path}/{Partition.by_day().pattern % DAY}/_feature_metadata/_{s.name}_METADATA.V1.json")
    rows = []
    for document in (md.read(written), md.read(md.Json0.stringify(md.Json0.output([s])))):
        for _, features in document.sets:
            rows += [(document.version, f["name"], f["valueType"].lower(), f["featureType"].lower(), len(f["range"])) for f in features]

    class Stubs(MetadataSet):
        metadata = (FeatureStub("Customer", VT.DECIMAL).as_feature_metadata(FT.CONTINUOUS, "ns", "stub", "A stub"),)

    rows += [(2, *x.split("|")[0].split(".")[1:], *x.split("|")[1:], 0) for x in md.Psv.output([Stubs()]).splitlines()]
    return spark.createDataFrame(rows, "version int, name string, value_type string, feature_type string, n_range int")


@query("""
    WITH l AS (SELECT string_split(regexp_replace(raw_line, '\r+$', ''), chr(9)) AS f FROM rating_lines),
    k AS (SELECT CASE WHEN len(f) < 4 THEN 'fewer' WHEN len(f) > 4 THEN 'more' WHEN list_contains(f, '\\N') OR NOT regexp_full_match(trim(f[3]), '[+-]?[0-9]+') THEN 'another type' ELSE 'good' END AS kind, f FROM l)
    SELECT kind, count(*) AS n, sum(CASE WHEN kind = 'good' THEN CAST(trim(f[3]) AS BIGINT) END) AS total FROM k GROUP BY kind""")
def q_lenient_text(spark, d):
    """Raw lines as a text source: decoded ones, and the others by what is wrong with them."""
    path = fresh_path(spark, "lines")
    table(spark, d, "rating_lines").select(F.regexp_replace("raw_line", "\r+$", "").alias("value")).write.text(path)
    good, bad = decode_leniently(spark, path, Schema("Line", "user_id string, movie_id string, rating int, timestamp string"), "\t")
    kind = F.when(F.col("error").startswith("field"), "another type").otherwise(F.substring_index("error", " ", 1))
    both = good.select(F.lit("good").alias("kind"), F.col("rating").cast("bigint").alias("r")).unionByName(bad.select(kind.alias("kind"), F.lit(None).cast("bigint").alias("r")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("total"))


# 2. Joins and features by their other names


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS entity, 'nation' AS name, n_name AS v_str FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def q_join_aliases(spark, d):
    src = From(ORDERS).inner_join_to(CUSTOMER).on(lambda o: o.o_custkey, lambda c: c.c_custkey).left_join_to(NATION).on(lambda o, c: c.c_nationkey, lambda n: n.n_nationkey)
    key = lambda o, c, n: o.o_orderkey.cast("string")
    s = _set(src, key, _builder(src, key).select(lambda o, c, n: n.n_name).as_feature(FT.NOMINAL, "nation", "Nation"))
    return shown(s.generate(bound(spark, d, src), CONTEXT), "v_str")


@query("""
    SELECT 'inner' AS how, CAST(c_custkey AS BIGINT) AS c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey
    UNION ALL SELECT 'left', c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey""")
def q_lift_join(spark, d):
    """Two DataFrames joined without a declared source."""
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    parts = [lift_join(c, o, lambda x: x.c_custkey, lambda x: x.o_custkey, how).select(F.lit(how).alias("how"), F.col("s1.c_custkey").cast("bigint").alias("c_custkey"), F.col("s2.o_orderkey").alias("o_orderkey")) for how in ("inner", "left")]
    return parts[0].unionByName(parts[1])


@query("""
    SELECT CAST(c_custkey AS VARCHAR) AS entity, 'nation' AS name, CAST(c_nationkey AS BIGINT) AS v FROM customer WHERE c_nationkey > 5
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'name_length', length(c_name) FROM customer WHERE c_acctbal > 0 AND c_nationkey > 5""")
def q_lifted_features(spark, d):
    """Features applied to a filtered DataFrame: one under another type, one declared by hand."""
    src = From(CUSTOMER)
    nation = _builder(src, _customer).select(lambda c: c.c_nationkey).as_feature(FT.ORDINAL, "nation", "Nation").as_type(FT.NOMINAL)
    own = general(src, "ns", "name_length", "Length", FT.DISCRETE, _customer, lambda c: F.length(c.c_name), lambda c: c.c_acctbal > 0)
    own = Feature(own.source, own.namespace, own.name, own.description, own.feature_type, own.entity, own.presence, own.value)
    df = bound(spark, d, src).filter(F.col("s1.c_nationkey") > 5)
    both = nation.apply(df).unionByName(own.apply(df))
    return both.select("entity", "name", F.col("value").cast("bigint").alias("v"))


@query("""
    WITH m AS (SELECT l_suppkey, l_extendedprice AS x, avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS mean FROM lineitem),
    g AS (SELECT l_suppkey, avg((x - mean) ** 2) AS m2, avg((x - mean) ** 3) AS m3, avg((x - mean) ** 4) AS m4 FROM m GROUP BY l_suppkey)
    SELECT CAST(l_suppkey AS VARCHAR) AS entity, 'skewness' AS name, round(m3 / m2 ** 1.5, 4) AS v_dbl FROM g
    UNION ALL SELECT CAST(l_suppkey AS VARCHAR), 'kurtosis', round(m4 / m2 ** 2 - 3, 4) FROM g""")
def q_agg_skewness_kurtosis(spark, d):
    src, key = From(LINEITEM), lambda x: x.l_suppkey.cast("string")
    b = _builder(src, key)
    s = _agg(src, key, b.select(agg.skewness(lambda x: x.l_extendedprice)).as_feature(FT.CONTINUOUS, "skewness", "Skew"), b.select(agg.kurtosis(lambda x: x.l_extendedprice)).as_feature(FT.CONTINUOUS, "kurtosis", "Tails"))
    return shown(s.generate(bound(spark, d, src), CONTEXT), "v_dbl")


# 3. Dates and times

_TIMES = r"""
    t AS (
        SELECT fact_id, origin, time, regexp_extract(time, '(Z|[+-][0-9]{2}:[0-9]{2})$', 1) AS z, try_strptime(substr(time, 1, 19), '%Y-%m-%dT%H:%M:%S') AS wall,
            CASE WHEN substr(time, 20, 1) = '.' THEN CAST(substr(time, 21, 3) AS INTEGER) ELSE 0 END AS ms, substr(time, 20, 1) = '.' AS with_ms
        FROM eavt WHERE regexp_full_match(time, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{3})?(Z|[+-][0-9]{2}:[0-9]{2})')),
    u AS (
        SELECT *, CASE WHEN z = 'Z' THEN 0 ELSE (CASE WHEN z LIKE '-%' THEN -1 ELSE 1 END) * (CAST(substr(z, 2, 2) AS INTEGER) * 60 + CAST(right(z, 2) AS INTEGER)) END AS minutes
        FROM t WHERE wall IS NOT NULL),
    v AS (
        SELECT fact_id, origin, with_ms, epoch_ms(wall) + ms - minutes * 60000 AS millis, strftime(wall, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(ms AS VARCHAR), 3, '0') AS own_wall,
            CASE WHEN z = 'Z' THEN '+00:00' ELSE z END AS own_zone FROM u)"""


def _ms_text(expr: str) -> str:
    return f"strftime(make_timestamp(({expr}) * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(({expr}) % 1000 AS VARCHAR), 3, '0')"


def _times(spark: SparkSession, d: str) -> DataFrame:
    time = F.col("time")
    both = F.coalesce(dt.parse_with_millis(time), dt.parse_without_millis(time))
    return table(spark, d, "eavt").select("fact_id", "origin", "time", both.alias("t")).filter("t IS NOT NULL")


@query(f"""
    WITH {_TIMES}
    SELECT fact_id, own_wall || own_zone AS own, {_ms_text('millis')} || '+00:00' AS utc, CASE WHEN with_ms THEN own_wall || '+05:30' END AS moved FROM v""")
def q_times(spark, d):
    """Times with and without milliseconds in their own offset, in UTC, and with another offset."""
    moved = dt.parse_with_offset(F.col("time"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", 5, 30)
    wall = F.when(dt.parse_with_millis(F.col("time")).isNotNull(), dt.rfc3339(moved))
    own = dt.strict(F.col("time"), F.col("t"))
    return _times(spark, d).select("fact_id", dt.rfc3339(own).alias("own"), dt.rfc3339(dt.to_utc(F.col("t"))).alias("utc"), wall.alias("moved"))


@query(f"""
    WITH {_TIMES}
    SELECT origin, {_ms_text('min(millis)')} || '+00:00' AS earliest, {_ms_text('max(millis)')} || '+00:00' AS latest FROM v GROUP BY origin""")
def q_times_ordered(spark, d):
    g = _times(spark, d).groupBy("origin").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return g.select("origin", dt.rfc3339(dt.to_utc(F.col("a"))).alias("earliest"), dt.rfc3339(dt.to_utc(F.col("b"))).alias("latest"))


@query("""
    SELECT o_orderpriority, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day, count(*) AS n FROM orders GROUP BY o_orderpriority""")
def q_dates_strict(spark, d):
    """Days read strictly from text of a pattern, in order, and written as ISO days."""
    day = dt.parse_date_strict(F.date_format("o_orderdate", "dd/MM/yyyy"), "dd/MM/yyyy")
    g = table(spark, d, "orders").select("o_orderpriority", day.alias("day")).groupBy("o_orderpriority").agg(F.min("day").alias("a"), F.max("day").alias("b"), F.count("day").alias("n"))
    return g.select("o_orderpriority", dt.iso_date(F.col("a")).alias("first_day"), dt.iso_date(F.col("b")).alias("last_day"), "n")
