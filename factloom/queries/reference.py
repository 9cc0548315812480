"""Queries for each operator of the feature engine, with DuckDB twins.

All give typed facts; doubles are rounded, as sums depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import (
    AggregationFeatureSet,
    BasicFeatureSet,
    DataFrameSource,
    FeatureContext,
    FeatureSet,
    From,
    Join,
    PivotFeatureSet,
    QueryFeatureSet,
    Record,
    Schema,
    agg,
    eavt,
    from_,
    general,
    join,
    join_multi,
    left_join,
)
from factloom.functions import datetimes as dt
from factloom.plans.features import FeatureSetBuilder
from factloom.shared import table
from factloom.types import FeatureType as FT

CONTEXT = FeatureContext(1_420_070_400_000)  # 2015-01-01 UTC


class OrderRecord(Record):
    """A record with derived columns."""

    @property
    def day(self):
        return self.o_orderdate.cast("date")

    @property
    def large(self):
        return self.o_totalprice >= 200_000


CUSTOMER = Schema("Customer", "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
ORDERS = Schema("Order", "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string", record=OrderRecord)
LINEITEM = Schema("LineItem", "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")
NATION = Schema("Nation", "n_nationkey int, n_name string, n_regionkey int")
REGION = Schema("Region", "r_regionkey int, r_name string")
SUPPLIER = Schema("Supplier", "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")
PART = Schema("Part", "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
EVENT = Schema("Event", "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
USER = Schema("User", "id string, age int, gender string, occupation string, zipcode string", optional=("age", "gender", "occupation", "zipcode"))
MOVIE = Schema("Movie", "id string, title string, release_date string, comedy int, drama int, action int", optional=("release_date",))
RATING = Schema("Rating", "user_id string, movie_id string, rating int, timestamp string", optional=("user_id", "movie_id", "rating", "timestamp"))
DIRECTOR = Schema("Director", "name string, movietitle string", optional=("name",))

TABLES = {"Customer": "customer", "Order": "orders", "LineItem": "lineitem", "Nation": "nation", "Region": "region", "Supplier": "supplier", "Part": "part", "Event": "events", "User": "users", "Movie": "movies", "Rating": "ratings", "Director": "directors"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def ds(spark: SparkSession, d: str, schema: Schema) -> DataFrameSource:
    return DataFrameSource(table(spark, d, TABLES[schema.name]))


def bound(spark: SparkSession, d: str, source, binder=None) -> DataFrame:
    schemas = [source.first, *[s.schema for s in source.steps]]
    return source.bind(binder or join_multi(*[ds(spark, d, s) for s in schemas])).load()


def shown(facts: DataFrame, *carriers: str, time: bool = False, digits: int = 4) -> DataFrame:
    cols = [F.round(c, digits).alias(c) if c == "v_dbl" else F.col(c) for c in carriers]
    return facts.select("entity", "name", *cols, *(["time"] if time else []))


# 1. Row features


class CustomerPivot(PivotFeatureSet):
    namespace, source = "pivot", From(CUSTOMER)

    def entity(self, c):
        return c.c_custkey.cast("string")

    @property
    def features(self):
        return [
            self.pivot("c_name", "Name", FT.NOMINAL),
            self.pivot("c_nationkey", "Nation", FT.NOMINAL),
            self.pivot("c_acctbal", "Balance", FT.CONTINUOUS),
            self.pivot("c_mktsegment", "Segment", FT.NOMINAL),
        ]


@query("""
    SELECT CAST(c_custkey AS VARCHAR) AS entity, n AS name, CASE n WHEN 'c_nationkey' THEN CAST(c_nationkey AS BIGINT) END AS v_long,
        CASE n WHEN 'c_acctbal' THEN round(c_acctbal, 4) END AS v_dbl, CASE n WHEN 'c_name' THEN c_name WHEN 'c_mktsegment' THEN c_mktsegment END AS v_str
    FROM customer CROSS JOIN (VALUES ('c_name'), ('c_nationkey'), ('c_acctbal'), ('c_mktsegment')) t(n)""")
def q_pivot_customer(spark, d):
    s = CustomerPivot()
    return shown(s.generate(bound(spark, d, s.source), CONTEXT), "v_long", "v_dbl", "v_str")


class UserAges(BasicFeatureSet):
    namespace, source = "users", From(USER)

    def entity(self, u):
        return u.id

    @property
    def features(self):
        return [
            self.basic_feature("age_or_null", "Age, null where unknown", FT.CONTINUOUS, lambda u: u.age),
            general(self.source, self.namespace, "age_if_known", "Age where known", FT.CONTINUOUS, self.entity, lambda u: u.age, lambda u: u.age.isNotNull()),
        ]


@query("""
    SELECT id AS entity, 'age_or_null' AS name, CAST(age AS BIGINT) AS v_long FROM users
    UNION ALL SELECT id, 'age_if_known', CAST(age AS BIGINT) FROM users WHERE age IS NOT NULL""")
def q_basic_null_vs_absent(spark, d):
    s = UserAges()
    return shown(s.generate(bound(spark, d, s.source), CONTEXT), "v_long")


def _builder(source, entity) -> FeatureSetBuilder:
    return source.builder("ns", entity)


def _set(source_, entity_, *features) -> FeatureSet:
    s = FeatureSet()
    s.namespace, s.source, s.entity, s.features = "ns", source_, entity_, list(features)
    return s


def _agg(source_, entity_, *features) -> AggregationFeatureSet:
    s = AggregationFeatureSet()
    s.namespace, s.source, s.entity, s.aggregation_features = "ns", source_, entity_, list(features)
    return s


def _customer(c):
    return c.c_custkey.cast("string")


@query("""
    SELECT CAST(c_custkey AS VARCHAR) AS entity, 'building_balance' AS name, round(c_acctbal, 4) AS v_dbl, CAST(NULL AS BOOLEAN) AS v_bool FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'in_debt', NULL, c_acctbal < 0 FROM customer""")
def q_fluent_where(spark, d):
    src = From(CUSTOMER)
    b = _builder(src, _customer)
    s = _set(
        src,
        _customer,
        b.select(lambda c: c.c_acctbal).where(lambda c: c.c_mktsegment == "BUILDING").and_where(lambda c: c.c_acctbal > 0).as_feature(FT.CONTINUOUS, "building_balance", "Balance"),
        b.select(lambda c: c.c_acctbal < 0).as_feature(FT.NOMINAL, "in_debt", "Whether in debt"),
    )
    return shown(s.generate(bound(spark, d, src), CONTEXT), "v_dbl", "v_bool")


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS entity, 'price_class' AS name, CAST(NULL AS BIGINT) AS v_long, CASE WHEN o_totalprice >= 200000 THEN 'large' ELSE 'small' END AS v_str FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'year', year(o_orderdate), NULL FROM orders""")
def q_collect_view(spark, d):
    src, key = From(ORDERS), lambda o: o.o_orderkey.cast("string")
    b = _builder(src, key)
    done = b.collect(lambda o: o.o_orderstatus == "F", lambda o: F.when(o.large, "large").otherwise("small"))
    s = _set(src, key, done.as_feature(FT.NOMINAL, "price_class", "Class of a finished order"), b.map(lambda o: F.year(o.day)).select(lambda y: y).as_feature(FT.ORDINAL, "year", "Year"))
    return shown(s.generate(bound(spark, d, src), CONTEXT), "v_long", "v_str")


class OrderBands(QueryFeatureSet):
    namespace, source, feature_type = "orders", From(ORDERS), FT.CONTINUOUS

    def entity(self, o):
        return o.o_orderkey.cast("string")

    def value(self, o):
        return o.o_totalprice

    @property
    def features(self):
        return [
            self.query_feature("low", "Low", lambda o: o.o_totalprice < 100_000),
            self.query_feature("middle", "Middle", lambda o: (o.o_totalprice >= 100_000) & (o.o_totalprice < 300_000)),
            self.query_feature("high", "High", lambda o: o.o_totalprice >= 300_000),
        ]


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS entity, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'middle' ELSE 'high' END AS name, round(o_totalprice, 4) AS v_dbl FROM orders""")
def q_query_set(spark, d):
    s = OrderBands()
    return shown(s.generate(bound(spark, d, s.source), CONTEXT), "v_dbl")


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS entity, 'price' AS name, round(o_totalprice, 4) AS v_dbl FROM orders
    WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderpriority = '1-URGENT'""")
def q_source_filter(spark, d):
    src = From(ORDERS).filter(lambda o: F.year(o.o_orderdate) == 1996).filter(lambda o: o.o_orderpriority == "1-URGENT")
    key = lambda o: o.o_orderkey.cast("string")
    s = _set(src, key, _builder(src, key).select(lambda o: o.o_totalprice).as_feature(FT.CONTINUOUS, "price", "Price"))
    return shown(s.generate(bound(spark, d, src), CONTEXT), "v_dbl")


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS entity, 'age_in_days' AS name, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS BIGINT) AS v_long FROM orders
    WHERE o_orderdate >= TIMESTAMP '1998-01-01'""")
def q_context_filter(spark, d):
    ctx = Schema("Day", "day date, since date")
    src = From(ORDERS).with_context(ctx).filter(lambda o, c: o.day >= c.since)
    key = lambda o, c: o.o_orderkey.cast("string")
    s = _set(src, key, _builder(src, key).select(lambda o, c: F.datediff(c.day, o.day)).as_feature(FT.CONTINUOUS, "age_in_days", "Age"))
    df = src.bind_with_context(from_(ds(spark, d, ORDERS)), {"day": "2002-01-01", "since": "1998-01-01"}).load()
    return shown(s.generate(df, CONTEXT), "v_long")


class TimedOrders(FeatureSet):
    namespace, source = "orders", From(ORDERS)

    def entity(self, o):
        return o.o_custkey.cast("string")

    def time(self, o, context):
        return F.unix_millis(o.o_orderdate)

    @property
    def features(self):
        return [self.builder.select(lambda o: o.o_orderstatus).as_feature(FT.NOMINAL, "status", "Status")]


@query("SELECT CAST(o_custkey AS VARCHAR) AS entity, 'status' AS name, o_orderstatus AS v_str, CAST(epoch_ms(o_orderdate) AS BIGINT) AS time FROM orders")
def q_record_time(spark, d):
    s = TimedOrders()
    return shown(s.generate(bound(spark, d, s.source), CONTEXT), "v_str", time=True)


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS entity, 'priority' AS attribute, o_orderpriority AS value, '2015-01-01' AS time FROM orders
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'customer', CAST(o_custkey AS VARCHAR), '2015-01-01' FROM orders
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'day', strftime(o_orderdate, '%Y-%m-%d'), '2015-01-01' FROM orders
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'finished', CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE '\\N' END, '2015-01-01' FROM orders""")
def q_eavt_encoded(spark, d):
    src, key = From(ORDERS), lambda o: o.o_orderkey.cast("string")
    b = _builder(src, key)
    s = _set(
        src,
        key,
        b.select(lambda o: o.o_orderpriority).as_feature(FT.NOMINAL, "priority", "Priority"),
        b.select(lambda o: o.o_custkey).as_feature(FT.NOMINAL, "customer", "Customer"),
        b.select(lambda o: o.day).as_feature(FT.INSTANT, "day", "Day"),
        b.select(lambda o: F.when(o.o_orderstatus == "F", F.lit(True))).as_feature(FT.NOMINAL, "finished", "Finished"),
    )
    return eavt(s.generate(bound(spark, d, src), CONTEXT, encoded=True))


@query("""
    SELECT CAST(c_custkey AS VARCHAR) AS feature_entity, 'segment' AS feature_name, c_mktsegment AS feature_value, '2015-01-01' AS feature_time FROM customer""")
def q_custom_encoder(spark, d):
    src = From(CUSTOMER)
    s = _set(src, _customer, _builder(src, _customer).select(lambda c: c.c_mktsegment).as_feature(FT.NOMINAL, "segment", "Segment"))
    e = eavt(s.generate(bound(spark, d, src), CONTEXT, encoded=True))
    return e.toDF("feature_entity", "feature_name", "feature_value", "feature_time")


@query("""
    SELECT CAST(c_custkey AS VARCHAR) AS entity, 'balance' AS name, round(c_acctbal, 4) AS v_dbl FROM customer
    UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'orders_value', round(sum(o_totalprice), 4) FROM orders GROUP BY o_custkey""")
def q_eavt_multi_set(spark, d):
    c, o = From(CUSTOMER), From(ORDERS)
    key = lambda x: x.o_custkey.cast("string")
    a = _set(c, _customer, _builder(c, _customer).select(lambda x: x.c_acctbal).as_feature(FT.CONTINUOUS, "balance", "Balance"))
    b = _agg(o, key, _builder(o, key).select(agg.sum_(lambda x: x.o_totalprice)).as_feature(FT.CONTINUOUS, "orders_value", "Value"))
    return shown(a.generate(bound(spark, d, c), CONTEXT), "v_dbl").unionByName(shown(b.generate(bound(spark, d, o), CONTEXT), "v_dbl"))


# 2. Aggregation


def _order(x):
    return x.l_orderkey.cast("string")


def _lines(spark, d, *features, carriers=("v_long",), digits=4):
    src = From(LINEITEM)
    b = _builder(src, _order)
    return shown(_agg(src, _order, *[f(b) for f in features]).generate(bound(spark, d, src), CONTEXT), *carriers, digits=digits)


_ENTITY = "CAST(l_orderkey AS VARCHAR) AS entity"


@query(f"""
    WITH g AS (SELECT {_ENTITY}, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_orderkey)
    SELECT entity, 'lines' AS name, CAST(n AS BIGINT) AS v_long FROM g UNION ALL SELECT entity, 'returned', CAST(r AS BIGINT) FROM g""")
def q_agg_size_count(spark, d):
    return _lines(
        spark, d, lambda b: b.select(agg.size()).as_feature(FT.DISCRETE, "lines", "Lines"), lambda b: b.select(agg.count(lambda x: x.l_returnflag == "R")).as_feature(FT.DISCRETE, "returned", "Returned lines")
    )


@query(f"SELECT {_ENTITY}, 'avg_price' AS name, round(avg(l_extendedprice), 6) AS v_dbl FROM lineitem GROUP BY l_orderkey")
def q_agg_avg(spark, d):
    return _lines(spark, d, lambda b: b.select(agg.avg(lambda x: x.l_extendedprice)).as_feature(FT.CONTINUOUS, "avg_price", "Mean price"), carriers=("v_dbl",), digits=6)


@query(f"SELECT {_ENTITY}, 'avg_quantity' AS name, round(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS v_dbl FROM lineitem GROUP BY l_orderkey")
def q_agg_avg_decimal(spark, d):
    out = _lines(spark, d, lambda b: b.select(agg.avg_decimal(lambda x: x.l_quantity.cast("decimal(18,2)"))).as_feature(FT.CONTINUOUS, "avg_quantity", "Mean quantity"), carriers=("v_dec",))
    return out.select("entity", "name", F.round(F.col("v_dec").cast("double"), 4).alias("v_dbl"))


@query(f"""
    WITH g AS (SELECT {_ENTITY}, min(l_quantity) AS a, max(l_quantity) AS z FROM lineitem GROUP BY l_orderkey)
    SELECT entity, 'least' AS name, a AS v_dbl FROM g UNION ALL SELECT entity, 'most', z FROM g""")
def q_agg_min_max(spark, d):
    return _lines(
        spark, d, lambda b: b.select(agg.min_(lambda x: x.l_quantity)).as_feature(FT.CONTINUOUS, "least", "Least"), lambda b: b.select(agg.max_(lambda x: x.l_quantity)).as_feature(FT.CONTINUOUS, "most", "Most"), carriers=("v_dbl",)
    )


@query("""
    WITH g AS (SELECT movie_id AS entity, CASE WHEN count(*) = count(rating) THEN min(rating) END AS a, max(rating) AS z FROM ratings WHERE movie_id IS NOT NULL GROUP BY movie_id)
    SELECT entity, 'least' AS name, CAST(a AS BIGINT) AS v_long FROM g UNION ALL SELECT entity, 'most', CAST(z AS BIGINT) FROM g""")
def q_agg_optional_min(spark, d):
    src = From(RATING).filter(lambda r: r.movie_id.isNotNull())
    key = lambda r: r.movie_id
    b = _builder(src, key)
    s = _agg(src, key, b.select(agg.min_(lambda r: r.rating, optional=True)).as_feature(FT.CONTINUOUS, "least", "Least"), b.select(agg.max_(lambda r: r.rating, optional=True)).as_feature(FT.CONTINUOUS, "most", "Most"))
    return shown(s.generate(bound(spark, d, src), CONTEXT), "v_long")


@query("""
    WITH g AS (SELECT CAST(o_custkey AS VARCHAR) AS entity, arg_max(o_orderkey, row(o_totalprice, o_orderkey)) AS z, arg_min(o_orderkey, row(o_totalprice, o_orderkey)) AS a FROM orders GROUP BY o_custkey)
    SELECT entity, 'dearest' AS name, CAST(z AS BIGINT) AS v_long FROM g UNION ALL SELECT entity, 'cheapest', CAST(a AS BIGINT) FROM g""")
def q_agg_maxby_minby(spark, d):
    src, key = From(ORDERS), lambda o: o.o_custkey.cast("string")
    b = _builder(src, key)
    s = _agg(
        src,
        key,
        b.select(agg.max_by(lambda o: o.o_totalprice, lambda o: o.o_orderkey)).as_feature(FT.NOMINAL, "dearest", "Dearest"),
        b.select(agg.min_by(lambda o: o.o_totalprice, lambda o: o.o_orderkey)).as_feature(FT.NOMINAL, "cheapest", "Cheapest"),
    )
    return shown(s.generate(bound(spark, d, src), CONTEXT), "v_long")


@query(f"SELECT {_ENTITY}, 'total' AS name, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE), 4) AS v_dbl FROM lineitem GROUP BY l_orderkey")
def q_agg_sum_decimal(spark, d):
    out = _lines(spark, d, lambda b: b.select(agg.sum_(lambda x: x.l_extendedprice.cast("decimal(18,4)"))).as_feature(FT.CONTINUOUS, "total", "Total"), carriers=("v_dec",))
    return out.select("entity", "name", F.round(F.col("v_dec").cast("double"), 4).alias("v_dbl"))


@query("SELECT movie_id AS entity, 'values' AS name, CAST(count(DISTINCT rating) + max(CASE WHEN rating IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS v_long FROM ratings WHERE movie_id IS NOT NULL GROUP BY movie_id")
def q_agg_unique(spark, d):
    src, key = From(RATING).filter(lambda r: r.movie_id.isNotNull()), lambda r: r.movie_id
    s = _agg(src, key, _builder(src, key).select(agg.unique_count_by(lambda r: r.rating)).as_feature(FT.DISCRETE, "values", "Different ratings"))
    return shown(s.generate(bound(spark, d, src), CONTEXT), "v_long")


@query(f"""
    SELECT {_ENTITY}, 'spread' AS name, CASE WHEN count(*) > 1 THEN round(stddev_pop(l_quantity), 4) END AS v_dbl, count(*) = 1 AS is_nan FROM lineitem GROUP BY l_orderkey""")
def q_agg_stddev(spark, d):
    out = _lines(spark, d, lambda b: b.select(agg.stddev(lambda x: x.l_quantity)).as_feature(FT.CONTINUOUS, "spread", "Spread"), carriers=("v_dbl",))
    return out.select("entity", "name", F.when(~F.isnan("v_dbl"), F.col("v_dbl")).alias("v_dbl"), F.isnan("v_dbl").alias("is_nan"))


@query(f"""
    SELECT {_ENTITY}, 'returned_quantity' AS name, round(sum(l_quantity), 4) AS v_dbl FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey""")
def q_agg_where(spark, d):
    return _lines(spark, d, lambda b: b.select(agg.sum_(lambda x: x.l_quantity)).where(lambda x: x.l_returnflag == "R").as_feature(FT.CONTINUOUS, "returned_quantity", "Returned"), carriers=("v_dbl",))


@query(f"""
    SELECT {_ENTITY}, 'many_lines' AS name, CAST(count(*) AS BIGINT) AS v_long FROM lineitem GROUP BY l_orderkey HAVING count(*) > 5""")
def q_agg_having(spark, d):
    return _lines(spark, d, lambda b: b.select(agg.size()).having(lambda a: a.n > 5).as_feature(FT.DISCRETE, "many_lines", "Lines"))


@query("""
    SELECT CAST(user_id AS VARCHAR) AS entity, 'mean_value' AS name, round(avg(value), 4) AS v_dbl FROM events WHERE event_type = 'click' GROUP BY user_id HAVING count(value) > 10""")
def q_agg_having_on_avg_count(spark, d):
    src, key = From(EVENT), lambda e: e.user_id.cast("string")
    s = _agg(src, key, _builder(src, key).select(agg.avg(lambda e: e.value)).where(lambda e: e.event_type == "click").having(lambda a: a.count > 10).as_feature(FT.CONTINUOUS, "mean_value", "Mean"))
    return shown(s.generate(bound(spark, d, src), CONTEXT), "v_dbl")


@query(f"""
    SELECT {_ENTITY}, 'discount_rate' AS name, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 4) AS v_dbl FROM lineitem GROUP BY l_orderkey""")
def q_agg_custom(spark, d):
    rate = agg.of(
        whole=lambda x, here: F.sum(F.when(here, x.l_extendedprice)),
        off=lambda x, here: F.sum(F.when(here, x.l_extendedprice * x.l_discount)),
    )(lambda a: a.off / a.whole)
    return _lines(spark, d, lambda b: b.select(rate).as_feature(FT.CONTINUOUS, "discount_rate", "Rate"), carriers=("v_dbl",))


@query(f"SELECT {_ENTITY}, 'variance' AS name, round(var_pop(l_quantity), 4) AS v_dbl FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def q_agg_variance(spark, d):
    return _lines(spark, d, lambda b: b.select(agg.variance(lambda x: x.l_quantity)).having(lambda a: a.n > 1).as_feature(FT.CONTINUOUS, "variance", "Variance"), carriers=("v_dbl",))


# 3. Joins


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS entity, 'ship_delay' AS name, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS BIGINT) AS v_long FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O'""")
def q_join_inner(spark, d):
    src = Join(ORDERS).to(LINEITEM).on(lambda o: o.o_orderkey, lambda x: x.l_orderkey).filter(lambda o, x: o.o_orderstatus == "O")
    key = lambda o, x: o.o_orderkey.cast("string")
    s = _set(src, key, _builder(src, key).select(lambda o, x: F.datediff(x.l_shipdate.cast("date"), o.day)).as_feature(FT.CONTINUOUS, "ship_delay", "Delay"))
    return shown(s.generate(bound(spark, d, src, join(ds(spark, d, ORDERS), ds(spark, d, LINEITEM))), CONTEXT), "v_long")


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS entity, 'n_lines' AS name, CAST(count(l_orderkey) AS BIGINT) AS v_long FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def q_join_left(spark, d):
    src = Join.left(ORDERS).to(LINEITEM).on(lambda o: o.o_orderkey, lambda x: x.l_orderkey)
    key = lambda o, x: o.o_orderkey.cast("string")
    s = _agg(src, key, _builder(src, key).select(agg.count(lambda o, x: x.is_defined)).as_feature(FT.DISCRETE, "n_lines", "Lines"))
    return shown(s.generate(bound(spark, d, src, left_join(ds(spark, d, ORDERS), ds(spark, d, LINEITEM))), CONTEXT), "v_long")


_COMEDY = """
    SELECT m.id AS entity, 'comedy_avg_rating' AS name, round(avg(r.rating), 4) AS v_dbl FROM movies m JOIN ratings r ON m.id = r.movie_id WHERE m.comedy = 1 GROUP BY m.id"""


def _comedies(spark, d, src, movies):
    key = lambda m, r: m.id
    s = _agg(src, key, _builder(src, key).select(agg.avg(lambda m, r: r.rating)).as_feature(FT.CONTINUOUS, "comedy_avg_rating", "Mean rating"))
    return shown(s.generate(bound(spark, d, src, join(movies, ds(spark, d, RATING))), CONTEXT), "v_dbl")


@query(_COMEDY)
def q_join_postfilter(spark, d):
    src = Join(MOVIE).to(RATING).on(lambda m: m.id, lambda r: r.movie_id).filter(lambda m, r: m.comedy == 1)
    return _comedies(spark, d, src, ds(spark, d, MOVIE))


@query(_COMEDY)
def q_join_prefilter(spark, d):
    src = Join(MOVIE).to(RATING).on(lambda m: m.id, lambda r: r.movie_id)
    return _comedies(spark, d, src, ds(spark, d, MOVIE).where(lambda df: df.comedy == 1))


@query("""
    SELECT d.name AS entity, 'director_avg_rating' AS name, round(avg(r.rating), 4) AS v_dbl
    FROM directors d JOIN movies m ON d.movietitle = m.title JOIN ratings r ON m.id = r.movie_id WHERE d.name IS NOT NULL AND d.name <> '' GROUP BY d.name""")
def q_join_multi3(spark, d):
    src = Join.multiway(DIRECTOR).inner(MOVIE).on(lambda a: a.movietitle, lambda m: m.title).filter(lambda a, m: a.name.isNotNull() & (a.name != "")).inner(RATING).on(lambda a, m: m.id, lambda r: r.movie_id)
    key = lambda a, m, r: a.name
    s = _agg(src, key, _builder(src, key).select(agg.avg(lambda a, m, r: r.rating)).as_feature(FT.CONTINUOUS, "director_avg_rating", "Mean rating"))
    return shown(s.generate(bound(spark, d, src), CONTEXT), "v_dbl")


@query("""
    SELECT CAST(c_custkey AS VARCHAR) AS entity, 'line_part' AS name, p_brand AS v_str FROM customer JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey WHERE c_acctbal > 5000""")
def q_join_multi4_mixed(spark, d):
    src = (
        Join.multiway(CUSTOMER).inner(ORDERS).on(lambda c: c.c_custkey, lambda o: o.o_custkey).filter(lambda c, o: c.c_acctbal > 5_000)
        .left(LINEITEM).on(lambda c, o: o.o_orderkey, lambda x: x.l_orderkey).left(PART).on(lambda c, o, x: x.l_partkey, lambda p: p.p_partkey)
    )
    key = lambda c, *_: c.c_custkey.cast("string")
    s = _set(src, key, _builder(src, key).select(lambda c, o, x, p: p.p_brand).as_feature(FT.NOMINAL, "line_part", "Brand"))
    return shown(s.generate(bound(spark, d, src), CONTEXT), "v_str")


@query("""
    SELECT r_name AS entity, 'quantity' AS name, round(sum(l_quantity), 2) AS v_dbl
    FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey
    LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE p_size > 10 AND s_acctbal > 0 GROUP BY r_name""")
def q_join_multi7(spark, d):
    src = (
        Join.multiway(REGION).inner(NATION).on(lambda r: r.r_regionkey, lambda n: n.n_regionkey)
        .inner(CUSTOMER).on(lambda r, n: n.n_nationkey, lambda c: c.c_nationkey)
        .inner(ORDERS).on(lambda r, n, c: c.c_custkey, lambda o: o.o_custkey)
        .left(LINEITEM).on(lambda r, n, c, o: o.o_orderkey, lambda x: x.l_orderkey)
        .left(PART).on(lambda r, n, c, o, x: x.l_partkey, lambda p: p.p_partkey)
        .left(SUPPLIER).on(lambda r, n, c, o, x, p: x.l_suppkey, lambda s: s.s_suppkey)
        .filter(lambda r, n, c, o, x, p, s: (p.p_size > 10) & (s.s_acctbal > 0))
    )
    key = lambda r, *_: r.r_name
    s = _agg(src, key, _builder(src, key).select(agg.sum_(lambda r, n, c, o, x, p, s: x.l_quantity)).as_feature(FT.CONTINUOUS, "quantity", "Quantity"))
    out = s.generate(bound(spark, d, src), CONTEXT)
    return out.select("entity", "name", F.round("v_dbl", 2).alias("v_dbl"))


@query("""
    SELECT a.n_name AS entity, 'neighbours' AS name, CAST(count(b.n_name) AS BIGINT) AS v_long FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_regionkey GROUP BY a.n_name""")
def q_self_join(spark, d):
    src = Join.left(NATION).to(NATION).on(lambda n: n.n_regionkey, lambda n: n.n_regionkey)
    key = lambda a, b: a.n_name
    s = _agg(src, key, _builder(src, key).select(agg.count(lambda a, b: b.is_defined)).as_feature(FT.DISCRETE, "neighbours", "Nations of the region"))
    return shown(s.generate(bound(spark, d, src), CONTEXT), "v_long")


@query("""
    SELECT a.id AS entity, 'same_kind' AS name, CAST(count(*) AS BIGINT) AS v_long FROM (SELECT DISTINCT id, gender, occupation FROM users) a
    JOIN (SELECT DISTINCT gender, occupation FROM users) b ON a.gender IS NOT DISTINCT FROM b.gender AND a.occupation IS NOT DISTINCT FROM b.occupation GROUP BY a.id""")
def q_join_optional_keys(spark, d):
    kind = Schema("Kind", "gender string, occupation string", optional=("gender", "occupation"))
    who = Schema("Who", "id string, gender string, occupation string", optional=("gender", "occupation"))
    src = Join(who).to(kind).on(lambda u: (u.gender, u.occupation), lambda k: (k.gender, k.occupation), null_safe=True)
    key = lambda u, k: u.id
    s = _agg(src, key, _builder(src, key).select(agg.size()).as_feature(FT.DISCRETE, "same_kind", "Kinds alike"))
    users = table(spark, d, "users")
    left = DataFrameSource(users.select("id", "gender", "occupation")).distinct()
    right = DataFrameSource(users.select("gender", "occupation")).distinct()
    return shown(s.generate(bound(spark, d, src, join(left, right)), CONTEXT), "v_long")


# 4. Data sources


@query("SELECT l_returnflag || l_linestatus AS entity, 'flags' AS name, l_linestatus AS v_str FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)")
def q_distinct(spark, d):
    kind = Schema("Flags", "l_returnflag string, l_linestatus string")
    src, key = From(kind), lambda f: F.concat(f.l_returnflag, f.l_linestatus)
    s = _set(src, key, _builder(src, key).select(lambda f: f.l_linestatus).as_feature(FT.NOMINAL, "flags", "Flags"))
    flags = ds(spark, d, LINEITEM).view(lambda df: df.select("l_returnflag", "l_linestatus")).distinct()
    return shown(s.generate(bound(spark, d, src, from_(flags)), CONTEXT), "v_str")


@query("""
    SELECT id AS entity, 'zipcode' AS name, zipcode AS v_str FROM
    (SELECT *, row_number() OVER (PARTITION BY id ORDER BY age NULLS FIRST, gender NULLS FIRST, occupation NULLS FIRST, zipcode NULLS FIRST) AS k FROM users) WHERE k = 1""")
def q_distinct_by(spark, d):
    src, key = From(USER), lambda u: u.id
    s = _set(src, key, _builder(src, key).select(lambda u: u.zipcode).as_feature(FT.NOMINAL, "zipcode", "Zip code"))
    users = ds(spark, d, USER).distinct_by(lambda df: df.id, deterministic=True)
    return shown(s.generate(bound(spark, d, src, from_(users)), CONTEXT), "v_str")


@query("SELECT CAST(c_custkey AS VARCHAR) AS entity, 'cents' AS name, CAST(round(c_acctbal * 100) AS BIGINT) AS v_long FROM customer")
def q_view(spark, d):
    kind = Schema("Account", "id bigint, cents bigint")
    src, key = From(kind), lambda a: a.id.cast("string")
    s = _set(src, key, _builder(src, key).select(lambda a: a.cents).as_feature(FT.CONTINUOUS, "cents", "Cents"))
    accounts = ds(spark, d, CUSTOMER).view(lambda df: df.select(F.col("c_custkey").alias("id"), F.round(df.c_acctbal * 100).cast("bigint").alias("cents")))
    return shown(s.generate(bound(spark, d, src, from_(accounts)), CONTEXT), "v_long")


# 5. Dates


@query("SELECT id AS entity, 'released' AS name, CAST(try_strptime(release_date, '%d-%b-%Y') AS DATE) AS v_date FROM movies")
def q_date_parse(spark, d):
    src, key = From(MOVIE), lambda m: m.id
    s = _set(src, key, _builder(src, key).select(lambda m: dt.parse_date(m.release_date, "dd-MMM-yyyy")).as_feature(FT.INSTANT, "released", "Release"))
    return shown(s.generate(bound(spark, d, src), CONTEXT), "v_date")


@query("""
    WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, DATE '2001-08-31' AS b FROM orders),
    lo AS (SELECT o_orderkey, least(a, b) AS a, greatest(a, b) AS b, CASE WHEN a > b THEN -1 ELSE 1 END AS s FROM o),
    y AS (SELECT *, year(b) - year(a) - CASE WHEN CAST(a + to_months(CAST(12 * (year(b) - year(a)) AS INTEGER)) AS DATE) > b THEN 1 ELSE 0 END AS y FROM lo),
    k AS (SELECT *, CAST(a + to_months(CAST(12 * y AS INTEGER)) AS DATE) AS c FROM y),
    m AS (SELECT *, 12 * (year(b) - year(c)) + month(b) - month(c) AS m0 FROM k),
    n AS (SELECT *, m0 - CASE WHEN CAST(c + to_months(CAST(m0 AS INTEGER)) AS DATE) > b THEN 1 ELSE 0 END AS m FROM m)
    SELECT CAST(o_orderkey AS VARCHAR) AS entity, CAST(s * y AS BIGINT) AS years, CAST(s * m AS BIGINT) AS months, CAST(s * (date_diff('day', CAST(c + to_months(CAST(m AS INTEGER)) AS DATE), b) % 7) AS BIGINT) AS days FROM n""")
def q_date_diff(spark, d):
    o = table(spark, d, "orders")
    x = dt.difference(F.col("o_orderdate").cast("date"), F.lit("2001-08-31").cast("date"))
    return o.select(F.col("o_orderkey").cast("string").alias("entity"), x.alias("x")).select("entity", *[F.col(f"x.{c}").cast("bigint").alias(c) for c in ("years", "months", "days")])
