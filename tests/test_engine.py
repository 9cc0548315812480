import math
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom import (
    AggregationFeatureSet,
    BasicFeatureSet,
    DataFrameSource,
    FeatureContext,
    FeatureSet,
    FeatureType as FT,
    From,
    Join,
    MapRange,
    MinMaxRange,
    PivotFeatureSet,
    QueryFeatureSet,
    Schema,
    SetRange,
    ValueType as VT,
    agg,
    eavt,
    from_,
    general,
    join,
    join_multi,
    left_join,
    lift_join,
)
from factloom.types import CONFORMS, conforms, value_type_of
from pyspark.sql import functions as F
from pyspark.sql import types as T

CTX = FeatureContext(1_420_070_400_000)
CUSTOMER = Schema("Customer", "id string, name string, age int, height double, credit double, time long, isVerified boolean", optional=("credit",))
ACCOUNT = Schema("Account", "id string, customer string, balance double, age int", optional=("age",))
PAIR = Schema("Pair", "k int, v string", optional=("k",))

CUSTOMERS = [("1", "a", 17, 1.5, None, 1000, True), ("2", "b", 18, 2.1, 5.0, 2000, False), ("3", "c", 65, 1.8, -1.0, 3000, True), ("4", "d", 66, 2.2, 0.0, 4000, False)]
ACCOUNTS = [("x", "1", 10.0, None), ("y", "1", 20.0, 30), ("z", "1", 30.0, 12), ("w", "2", 5.0, None)]


def load(spark, source, *rows_by_schema, binder=None):
    schemas = [source.first, *[s.schema for s in source.steps]]
    sources = [DataFrameSource(spark.createDataFrame(r, s.struct)) for r, s in zip(rows_by_schema, schemas, strict=True)]
    return source.bind(binder(*sources) if binder else join_multi(*sources)).load()


def made(cls, source, entity, *features):
    s = cls()
    s.namespace, s.source, s.entity = "ns", source, entity
    setattr(s, "features" if cls is FeatureSet else "aggregation_features", list(features))
    return s


def facts(s, df, carrier=None):
    rows = s.generate(df, CTX).collect()
    return sorted((r.entity, r.name, next((getattr(r, v.carrier) for v in VT if getattr(r, v.carrier) is not None), None)) for r in rows)


# types


def test_conformance_table():
    legal = {("CONTINUOUS", v) for v in ("INTEGRAL", "DECIMAL", "FLOATING_POINT")} | {("DISCRETE", "INTEGRAL")} | {("ORDINAL", v) for v in ("INTEGRAL", "DECIMAL", "FLOATING_POINT", "STR")}
    legal |= {("NOMINAL", v) for v in ("INTEGRAL", "STR", "BOOL")} | {("INSTANT", "DATE"), ("INSTANT", "TIME")}
    assert {(f.name, v.name) for f in FT for v in VT if conforms(f, v)} == legal and len(CONFORMS) == 13


def test_lifting():
    for t, v in ((T.ByteType(), VT.INTEGRAL), (T.IntegerType(), VT.INTEGRAL), (T.FloatType(), VT.FLOATING_POINT), (T.DecimalType(5, 2), VT.DECIMAL), (T.StringType(), VT.STR), (T.DateType(), VT.DATE), (T.BooleanType(), VT.BOOL)):
        assert value_type_of(t) is v
    with pytest.raises(TypeError):
        value_type_of(T.ArrayType(T.LongType()))


def test_ranges():
    assert MinMaxRange(1, 5).contains(5) and not MinMaxRange(1, 5).contains(6) and MinMaxRange(1, 5).widest_value_size is None
    assert SetRange("a", "bcd", "a", None).values == ("a", "bcd", None) and SetRange("a", "bcd", None).widest_value_size == 3
    assert SetRange(1, 2).widest_value_size is None and SetRange().widest_value_size is None
    assert MapRange(("M", "male"), ("F", "female")).values == ("M", "F") and MapRange(("M", "x")).contains("M")
    with pytest.raises(TypeError):
        MinMaxRange(False, True)


# row features


def test_absent_is_not_null(spark):
    src, key = From(CUSTOMER), lambda c: c.id
    b = src.builder("ns", key)
    s = made(
        FeatureSet, src, key,
        general(src, "ns", "always", "", FT.CONTINUOUS, key, lambda c: c.credit),
        general(src, "ns", "if_known", "", FT.CONTINUOUS, key, lambda c: c.credit, lambda c: c.credit.isNotNull()),
        b.select(lambda c: c.credit).where(lambda c: c.credit > 0).as_feature(FT.CONTINUOUS, "positive", "null conditions are misses"),
    )
    df = load(spark, src, CUSTOMERS)
    got = facts(s, df)
    assert [x for x in got if x[1] == "always"] == [("1", "always", None), ("2", "always", 5.0), ("3", "always", -1.0), ("4", "always", 0.0)]
    assert [x[0] for x in got if x[1] == "if_known"] == ["2", "3", "4"] and [x for x in got if x[1] == "positive"] == [("2", "positive", 5.0)]
    e = eavt(s.generate(df, CTX, encoded=True)).collect()
    assert ("1", "always", "\\N", "2015-01-01") in [tuple(r) for r in e]


def test_fluent_views_and_types(spark):
    src, key = From(CUSTOMER), lambda c: c.id
    b = src.builder("ns", key)
    tall = b.collect(lambda c: c.height > 2.0, lambda c: (c.age, c.height))
    s = made(
        FeatureSet, src, key,
        tall.select(lambda age, height: age).as_feature(FT.ORDINAL, "tallAge", "age of tall ones"),
        tall.collect(lambda age, height: age > 18, lambda age, height: height).as_feature(FT.CONTINUOUS, "h", "height of tall adults"),
        b.map(lambda c: c.age * 2).as_feature(FT.CONTINUOUS, "double", MinMaxRange(0, 300), "twice"),
        b.select(lambda c: c.isVerified).where(lambda c: c.age < 40).and_where(lambda c: c.id > "1").as_feature(FT.NOMINAL, "youngIsVerified", "verified"),
        b.select(lambda c: F.timestamp_millis(c.time).cast("date")).as_feature(FT.INSTANT, "day", "day"),
    )
    got = facts(s, load(spark, src, CUSTOMERS))
    assert [x for x in got if x[1] == "tallAge"] == [("2", "tallAge", 18), ("4", "tallAge", 66)] and [x for x in got if x[1] == "h"] == [("4", "h", 2.2)]
    assert [x for x in got if x[1] == "youngIsVerified"] == [("2", "youngIsVerified", False)] and len([x for x in got if x[1] == "double"]) == 4
    m = {x.name: x for x in s.metadata}
    assert m["double"].value_range == MinMaxRange(0, 300) and m["double"].value_type is VT.INTEGRAL and m["day"].value_type is VT.DATE and all(x.types_conform for x in s.metadata)
    f = s.features[2].as_type(FT.ORDINAL)
    assert f.metadata.feature_type is FT.ORDINAL and f.metadata.value_range is None
    for bad in (lambda: b.select(lambda c: c.name).as_feature(FT.CONTINUOUS, "x", ""), lambda: s.features[2].as_type(FT.INSTANT), lambda: b.select(lambda c: c.isVerified).as_feature(FT.ORDINAL, "x", "")):
        with pytest.raises(ValueError):
            bad()


def test_pivot_basic_and_query_sets(spark):
    class P(PivotFeatureSet):
        namespace, source = "p", From(CUSTOMER)

        def entity(self, c):
            return c.id

        @property
        def features(self):
            return [self.pivot("name", "n", FT.NOMINAL), self.pivot("credit", "c", FT.CONTINUOUS)]

    class B(BasicFeatureSet):
        namespace, source = "b", From(CUSTOMER)

        def entity(self, c):
            return c.id

        @property
        def features(self):
            return [self.basic_feature("wrong", "reported, not refused", FT.INSTANT, lambda c: c.age)]

    class Q(QueryFeatureSet):
        namespace, source, feature_type = "q", From(CUSTOMER), FT.CONTINUOUS

        def entity(self, c):
            return c.id

        def value(self, c):
            return c.height

        @property
        def features(self):
            return [self.query_feature("young", "", lambda c: c.age < 18), self.query_feature("mid", "", lambda c: c.age.between(18, 64)), self.query_feature("old", "", lambda c: c.age >= 65)]

    df = load(spark, From(CUSTOMER), CUSTOMERS)
    assert len(facts(P(), df)) == 8 and ("1", "credit", None) in facts(P(), df)
    assert [m.types_conform for m in B().metadata] == [False]
    assert [x[1] for x in facts(Q(), df)] == ["young", "mid", "old", "old"]
    assert P().name == "P" and P().metadata[0].source_type == "Customer"


# aggregation


def aggregated(spark, *features):
    src, key = From(ACCOUNT), lambda a: a.customer
    b = src.builder("ns", key)
    return made(AggregationFeatureSet, src, key, *[f(b) for f in features]), load(spark, src, ACCOUNTS)


def test_aggregators(spark):
    C, D, N = FT.CONTINUOUS, FT.DISCRETE, FT.NOMINAL
    s, df = aggregated(
        spark,
        lambda b: b.select(agg.size()).as_feature(D, "size", ""),
        lambda b: b.select(agg.size()).having(lambda a: a.n > 2).as_feature(D, "sizeBig", ""),
        lambda b: b.select(agg.count(lambda a: a.balance > 100)).as_feature(D, "none", ""),
        lambda b: b.select(agg.sum_(lambda a: a.balance)).where(lambda a: a.balance > 15).as_feature(C, "sum", ""),
        lambda b: b.select(agg.max_(lambda a: a.age)).as_feature(C, "max", ""),
        lambda b: b.select(agg.min_(lambda a: a.age)).as_feature(C, "min", ""),
        lambda b: b.select(agg.min_(lambda a: a.age, optional=True)).as_feature(C, "minOpt", ""),
        lambda b: b.select(agg.max_by(lambda a: a.balance, lambda a: a.id)).having(lambda a: a.record.age > 10).as_feature(N, "maxBy", ""),
        lambda b: b.select(agg.min_by(lambda a: F.lit(1), lambda a: a.id)).as_feature(N, "minByTie", ""),
        lambda b: b.select(agg.avg(lambda a: a.balance)).having(lambda a: a.count > 1).as_feature(C, "avg", ""),
        lambda b: b.select(agg.unique_count_by(lambda a: a.age)).as_feature(D, "unique", ""),
        lambda b: b.select(agg.size()).where(lambda a: a.balance > 1000).as_feature(D, "knownEmpty", ""),
        lambda b: b.collect(lambda a: a.age.isNotNull(), lambda a: a.age).select(agg.sum_(lambda age: age)).as_feature(D, "collect", ""),
        lambda b: b.select(agg.stddev(lambda a: a.balance)).as_feature(C, "sd", ""),
        lambda b: b.select(agg.of(n=lambda a, here: F.sum(F.when(here, a.balance * 2)))(lambda x: x.n)).as_feature(C, "custom", ""),
        lambda b: b.select(agg.sum_(lambda a: a.balance).and_then(lambda c: c / 10)).as_feature(C, "then", ""),
    )
    got = {(e, n): v for e, n, v in facts(s, df)}
    assert {n: v for (e, n), v in got.items() if e == "1"} == {
        "size": 3, "sizeBig": 3, "none": 0, "sum": 50.0, "max": 30, "min": 12, "minOpt": None, "maxBy": "z", "minByTie": "x", "avg": 20.0, "unique": 3, "collect": 42, "sd": pytest.approx(math.sqrt(200 / 3)), "custom": 120.0, "then": 6.0,
    }
    two = {n: v for (e, n), v in got.items() if e == "2"}
    assert math.isnan(two.pop("sd"))
    assert two == {"size": 1, "none": 0, "max": None, "min": None, "minOpt": None, "minByTie": "w", "unique": 1, "custom": 10.0, "then": 0.5}
    assert s.metadata[0].source_type == "Tuple2[String,Iterable[Account]]"
    plan = s.generate(df, CTX)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 or "Expand" not in plan


@pytest.mark.parametrize("values,mean", [(["1000000000000.02", "0.02"], "500000000000.02"), (["1200000000000.01", "1200000000000.03", "0.02"], "800000000000.02")])
def test_decimal_average_is_exact(spark, values, mean):
    kind = Schema("D", "k string, d decimal(38,18)")
    src, key = From(kind), lambda x: x.k
    s = made(AggregationFeatureSet, src, key, src.builder("n", key).select(agg.avg_decimal(lambda x: x.d)).as_feature(FT.CONTINUOUS, "m", ""))
    assert [v for _, _, v in facts(s, load(spark, src, [("k", Decimal(v)) for v in values]))] == [Decimal(mean)]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.one_of(st.none(), st.sampled_from([0, 17, 18, 64, 65, 150])), st.floats(-1e6, 1e6)), min_size=1, max_size=20))
def test_aggregates_equal_plain_python(spark, rows):
    kind = Schema("R", "k string, age int, x double", optional=("age",))
    src, key = From(kind), lambda r: r.k
    b = src.builder("n", key)
    s = made(
        AggregationFeatureSet, src, key,
        b.select(agg.size()).as_feature(FT.DISCRETE, "n", ""), b.select(agg.avg(lambda r: r.x)).as_feature(FT.CONTINUOUS, "avg", ""), b.select(agg.max_by(lambda r: r.age, lambda r: r.x)).as_feature(FT.CONTINUOUS, "by", ""),
        b.select(agg.size()).where(lambda r: r.age >= 65).as_feature(FT.DISCRETE, "old", ""),
    )
    got = {(e, n): v for e, n, v in facts(s, load(spark, src, rows))}
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        assert got[k, "n"] == len(mine) and got[k, "avg"] == pytest.approx(sum(r[2] for r in mine) / len(mine), rel=1e-9, abs=1e-6)
        assert got[k, "by"] == max(((r[1] if r[1] is not None else -1, r[2]) for r in mine))[1]
        old = sum(r[1] is not None and r[1] >= 65 for r in mine)
        assert got.get((k, "old")) == (old or None)


# joins

LEFT, RIGHT = [(1, "1"), (2, "2"), (2, "22"), (3, "333")], [(2, "2"), (2, "22"), (2, "222"), (3, "333"), (4, "4")]


def test_inner_and_left_joins(spark):
    inner = Join(PAIR).to(PAIR).on(lambda a: a.k, lambda b: b.k)
    rows = load(spark, inner, LEFT, RIGHT, binder=join).collect()
    assert len(rows) == 7
    left = Join.left(PAIR).to(PAIR).on(lambda a: a.k, lambda b: b.k)
    rows = load(spark, left, LEFT, RIGHT, binder=left_join).collect()
    assert len(rows) == 8 and [r.s1.v for r in rows if r.s2 is None] == ["1"]
    with pytest.raises(ValueError):
        load(spark, left, LEFT, RIGHT, binder=join)
    df = lift_join(spark.createDataFrame(LEFT, "k int, v string"), spark.createDataFrame(RIGHT, "k int, v string"), lambda a: a.k, lambda b: b.k)
    assert df.count() == 7


def test_a_match_of_nulls_is_a_match_and_null_keys(spark):
    src = Join.left(PAIR).to(PAIR).on(lambda a: a.k, lambda b: b.k, null_safe=True)
    rows = load(spark, src, [(None, "x"), (1, "y")], [(None, None)]).collect()
    assert {r.s1.v: r.s2 is not None for r in rows} == {"x": True, "y": False}
    plain = Join(PAIR).to(PAIR).on(lambda a: a.k, lambda b: b.k)
    assert load(spark, plain, [(None, "x")], [(None, None)]).collect() == []


def test_filters_stay_with_later_joins_and_multiway_keys_see_earlier_records(spark):
    src = Join.multiway(PAIR).inner(PAIR).on(lambda a: a.k, lambda b: b.k).filter(lambda a, b: a.v != b.v).left(PAIR).on(lambda a, b: (a.v, b.k), lambda c: (c.v, c.k)).filter(lambda a, b, c: c.is_defined)
    got = {(r.s1.v, r.s2.v, r.s3.v) for r in load(spark, src, LEFT, RIGHT, RIGHT).collect()}
    assert got == {("2", "22", "2"), ("2", "222", "2"), ("22", "2", "22"), ("22", "222", "22")}
    seven = Join.multiway(PAIR)
    for i in range(6):
        seven = (seven.inner if i % 2 else seven.left)(PAIR).on(lambda *r: r[0].k, lambda c: c.k)
    assert load(spark, seven, *[[(1, "a"), (2, "b")]] * 7).count() == 2


def test_context(spark):
    ctx = Schema("Ctx", "least int, day string")
    src = From(CUSTOMER).filter(lambda c: c.isVerified).with_context(ctx).filter(lambda c, x: c.age > x.least)
    key = lambda c, x: c.id
    s = made(FeatureSet, src, key, src.builder("n", key).select(lambda c, x: F.concat(c.name, x.day)).as_feature(FT.NOMINAL, "f", ""))
    df = src.bind_with_context(from_(DataFrameSource(spark.createDataFrame(CUSTOMERS, CUSTOMER.struct))), (20, "d")).load()
    assert facts(s, df) == [("3", "f", "cd")]


def test_pushdown_and_pruning_reach_the_scan(spark, tmp_path):
    spark.createDataFrame(CUSTOMERS, CUSTOMER.struct).write.parquet(str(tmp_path / "c"))
    src = From(CUSTOMER).filter(lambda c: c.age > 60)
    key = lambda c: c.id
    s = made(FeatureSet, src, key, src.builder("n", key).select(lambda c: c.height).as_feature(FT.CONTINUOUS, "h", ""))
    df = s.generate(src.bind(from_(DataFrameSource(spark.read.parquet(str(tmp_path / "c"))))).load(), CTX)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(age,60)" in plan and "ReadSchema: struct<id:string,age:int,height:double>" in plan


def test_features_and_sets_apply_without_a_sink(spark):
    from factloom import Feature

    src, key = From(CUSTOMER), lambda c: c.id
    c = src.view()
    own = Feature(src, "ns", "own", "any columns", FT.NOMINAL, c.id, F.rand(7) >= 0, F.upper(c.name))
    df = load(spark, src, CUSTOMERS)
    assert sorted(map(tuple, own.apply(df).collect())) == [(str(i), "own", x) for i, x in enumerate("ABCD", 1)]
    s = made(FeatureSet, src, key, own)
    assert "time" not in s.apply(df).columns and s.apply(df).count() == 4


def test_counters_and_optional_values_do_not_change_results(spark):
    from factloom.stats import Stats

    src = Join.left(PAIR).to(PAIR).on(lambda a: a.k, lambda b: b.k)
    a, b = (DataFrameSource(spark.createDataFrame(x, PAIR.struct)) for x in (LEFT, RIGHT))
    stats = Stats()
    assert src.bind(left_join(a, b)).load(stats).count() == 8
    assert dict(stats.values())["join.level1"] == 8
