import json
import logging
import os

import pytest

from factloom import AggregationFeatureSet, DataFrameSource, FeatureContext, FeatureSet, FeatureStub, From, MapRange, MetadataSet, MinMaxRange, ParquetSource, Partition, Partitions
from factloom import FeatureType as FT
from factloom import Schema, SetRange, TextSource, agg, decode_leniently, eavt, from_
from factloom import ValueType as VT
from factloom import cli, sinks
from factloom.job import FeatureJobConfig, FeatureSetExecution, FeatureSetExecutions, SimpleFeatureJob
from factloom.metadata import Json0, Json1, Psv, read
from factloom.stats import Stats
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

CTX = FeatureContext(1_420_070_400_000)
CUSTOMER = Schema("Customer", "id string, name string, age int, height double, credit double, time long, isVerified boolean", optional=("credit",))
ACCOUNT = Schema("Account", "id string, customer string, balance double, text string, name string, age int, min double, time long", optional=("name", "age", "min"))
RATING = Schema("Rating", "movie_id string, rating int")


@pytest.fixture
def texts(tmp_path):
    for folder, line in (("parts/status=ACTIVE", r"active_id|active_name|19|1.5|\N|12345|true"), ("parts/status=INACTIVE", r"inactive_id|inactive_name|21|1.6|\N|54321|true"), ("whole", r"unpart_id|unpart_name|19|1.5|\N|12345|true")):
        os.makedirs(tmp_path / folder)
        (tmp_path / folder / "records.txt").write_text(line + "\n")
    return tmp_path


def test_text_source(spark, texts):
    by = Partition.by_field("status")
    listed = TextSource(f"{texts}/parts", CUSTOMER, Partitions(by, "ACTIVE", "INACTIVE")).load()
    assert {(r.id, r.age, r.credit) for r in listed.collect()} == {("active_id", 19, None), ("inactive_id", 21, None)}
    assert TextSource(f"{texts}/parts", CUSTOMER, Partitions(by, "*")).load().count() == 2
    assert TextSource(f"{texts}/whole", CUSTOMER).load().count() == 1
    for bad in (ACCOUNT, Schema("Short", "a string, b string"), Schema("Typed", "id int, name string, age int, height double, credit string, time long, v boolean", optional=("credit",))):
        with pytest.raises(PySparkException, match="fields|another type"):
            TextSource(f"{texts}/whole", bad).load().count()
    with pytest.raises(TypeError):
        Partitions("a=%s", 1)


def test_lenient_text_keeps_quotes_and_empty_fields(spark, tmp_path):
    (tmp_path / "t.txt").write_text('"x|1\n|2\nz|q\nonly\n')
    good, bad = decode_leniently(spark, str(tmp_path / "t.txt"), Schema("S", "s string, n int"))
    assert sorted(map(tuple, good.collect())) == [("", 2), ('"x', 1)] and {" ".join(r.error.split(":")[0].split()[-2:]) for r in bad.collect()} == {"another type", "2 fields"}


def test_parquet_source_where_and_distincts(spark, tmp_path):
    df = spark.createDataFrame([(1, True), (1, True), (1, False), (2, True)], "a int, b boolean")
    df.write.parquet(str(tmp_path / "p/k=x"))
    pair = Schema("Pair", "a int, b boolean")
    src = ParquetSource(str(tmp_path / "p"), pair, Partitions("k=%s", "x"))
    assert src.load().columns == ["a", "b"] and src.load().count() == 4
    assert src.where(lambda d: d.a > 1).load().count() == 1 and src.distinct().load().count() == 3 and src.distinct_by(lambda d: d.a).load().count() == 2
    assert [tuple(r) for r in src.distinct_by(lambda d: d.a, deterministic=True).load().orderBy("a").collect()] == [(1, False), (2, True)]


class Ratings(AggregationFeatureSet):
    namespace, source = "userguide", From(RATING)

    def entity(self, r):
        return r.movie_id

    @property
    def aggregation_features(self):
        return [
            self.builder.select(agg.avg(lambda r: r.rating)).as_feature(FT.CONTINUOUS, "MOVIE_AVG_RATING", MinMaxRange(1, 5), "Mean"),
            self.builder.select(agg.stddev(lambda r: r.rating)).as_feature(FT.CONTINUOUS, "RATING_STANDARD_DEVIATION", "Spread"),
        ]


class Rows(FeatureSet):
    namespace, source = "rows", From(RATING)

    def entity(self, r):
        return r.movie_id

    @property
    def features(self):
        return [self.builder.select(lambda r: r.rating).as_feature(FT.NOMINAL, "R", MapRange((1, "bad"), (5, "good")), "Rating"), self.builder.select(lambda r: F.lit("x")).as_feature(FT.NOMINAL, "S", SetRange("x", None), "Text")]


def bound(spark, rows=((("1"), 3), ("2", 2), ("2", 5))):
    return Rows.source.bind(from_(DataFrameSource(spark.createDataFrame(list(rows), RATING.struct))))


def sink_of(kind, path, table):
    if kind == "text":
        return sinks.TextSink("features", str(path), table, sinks.DerivedSinkPartition.eavt_by_day())
    return sinks.ParquetSink("features", table, str(path), sinks.FixedSinkPartition.by_day("2015-01-01"))


def lines(path):
    return sorted(x for p, _, fs in os.walk(path) for f in fs if f.startswith("part") for x in open(os.path.join(p, f)).read().splitlines())


def test_golden_lines_of_a_text_job(spark, tmp_path):
    assert SimpleFeatureJob.generate(FeatureJobConfig(bound(spark), sink_of("text", tmp_path, "golden"), CTX), Ratings()) == 0
    day = tmp_path / "year=2015/month=01/day=01"
    assert lines(day) == ["1|MOVIE_AVG_RATING|3.0|2015-01-01", "1|RATING_STANDARD_DEVIATION|NaN|2015-01-01", "2|MOVIE_AVG_RATING|3.5|2015-01-01", "2|RATING_STANDARD_DEVIATION|1.5|2015-01-01"]
    assert (day / "_SUCCESS").exists() and not (tmp_path / "_SUCCESS").exists()
    assert spark.table("features.golden").filter("year = '2015'").count() == 4


@pytest.mark.parametrize("kind", ["text", "parquet"])
def test_commit_protocol(spark, tmp_path, kind):
    sink = sinks.MetadataSink(sink_of(kind, tmp_path, f"commit_{kind}"))
    encoded = Rows().generate(bound(spark).load(), CTX, encoded=True)
    paths = sink.write(encoded, Rows())
    assert paths == {f"{tmp_path}/year=2015/month=01/day=01"} and not sinks.is_committed(*paths)
    assert sink.write(encoded, Rows()) == paths
    assert spark.table(f"features.commit_{kind}").count() == 12
    (path,) = paths
    document = open(f"{path}/_feature_metadata/_Rows_METADATA.V1.json").read()
    assert read(document).write() == json.loads(document)
    sinks.commit(paths)
    with pytest.raises(sinks.AttemptedWriteToCommitted) as e:
        sink.write(encoded, Rows())
    assert e.value.exit_code == -3
    with pytest.raises(sinks.AlreadyCommitted) as e:
        sinks.commit([*paths, f"{tmp_path}/other"])
    assert e.value.exit_code == -2 and not os.path.exists(f"{tmp_path}/other/_SUCCESS")
    spark.catalog.refreshTable(f"features.commit_{kind}")
    assert spark.table(f"features.commit_{kind}").count() == 12
    assert SimpleFeatureJob.generate(FeatureJobConfig(bound(spark), sink, CTX), Rows()) == -3


@pytest.mark.parametrize("kind", ["text", "parquet"])
def test_parallel_and_sequential_sets(spark, tmp_path, kind):
    c = FeatureJobConfig(bound(spark), sink_of(kind, tmp_path, f"jobs_{kind}"), CTX)
    e = FeatureSetExecutions.of(FeatureSetExecution(c, Rows()), FeatureSetExecution(c, Ratings())).and_then(FeatureSetExecution(c, Rows()))
    assert SimpleFeatureJob.run(e) == 0
    assert spark.table(f"features.jobs_{kind}").count() == 16


def test_delimiter_conflict(spark, tmp_path):
    encoded = Rows().generate(bound(spark, [("a|b", 1)]).load(), CTX, encoded=True)
    with pytest.raises(PySparkException, match="delimiter"):
        sink_of("text", tmp_path / "a", "conflict_a").write(encoded, Rows())
    sink = sinks.TextSink("features", str(tmp_path / "b"), "conflict_b", sinks.FixedSinkPartition.by_day("2015-01-01"), conflict=lambda name, text, d: F.replace(text, F.lit(d), F.lit("/")))
    sink.write(encoded, Rows())
    assert lines(tmp_path / "b") == ["a/b|R|1|2015-01-01", "a/b|S|x|2015-01-01"]
    df = spark.createDataFrame([("x", None)], "a string, b string")
    assert df.select(sinks.serialised(df).alias("v")).first().v == "x|\\N"


def test_counters(spark, caplog):
    stats = Stats()
    a = DataFrameSource(spark.createDataFrame([(x,) for x in (1, 2, 3, 4, 2, 1)], "v int")).where(lambda d: d.v > 1)
    kind = Schema("V", "v int")
    from factloom import Join, join

    src = Join(kind).to(kind).on(lambda x: x.v, lambda y: y.v).filter(lambda x, y: x.v < 4)
    b = DataFrameSource(spark.createDataFrame([(x,) for x in (2, 2, 4, 4, 5)], "v int"))
    df = src.bind(join(a, b)).load(stats)
    assert df.count() == 4
    with caplog.at_level(logging.INFO):
        written = stats.write_log()
    assert [(n, v) for n, v in stats.values()] == [("load.dataframe", 6), ("where", 4), ("load.dataframe", 4), ("load.dataframe", 5), ("join.level1", 6), ("filter", 4)]
    assert written[2] == f"    {'where':<30} {4:>10d}"
    empty = Stats()
    src.bind(join(DataFrameSource(spark.createDataFrame([], "v int")), b)).load(empty).count()
    assert all(v == 0 for n, v in empty.values() if n != "load.dataframe")


# metadata and command line


class Blank(MetadataSet):
    metadata = [FeatureStub("Customer", VT.DECIMAL).as_feature_metadata(FT.CONTINUOUS, "ns", "Credit", MinMaxRange(1, 10), "d"), FeatureStub("Customer", VT.STR).as_feature_metadata(FT.INSTANT, "ns", "Odd", "d")]


def test_metadata_documents(spark):
    flat = Json0.output([Blank(), Rows()])
    assert flat[0] == {"namespace": "ns", "name": "Credit", "description": "d", "source": "Customer", "typesConform": True, "valueType": "decimal", "featureType": "continuous", "range": {"min": "1", "max": "10"}}
    assert flat[1]["typesConform"] is False and "range" not in flat[1] and flat[2]["range"] == ["1", "5"] and flat[3]["range"] == ["x", None]
    one = Json1.output([Blank()])
    assert one["version"] == 1 and one["featureSets"][0]["featureSet"] == "Blank" and one["featureSets"][0]["features"][0]["sourceType"] == "Customer"
    assert Psv.output([Blank(), Rows()]).splitlines() == ["ns.credit|bigdecimal|continuous", "ns.odd|string|datetime", "rows.r|int|categorical", "rows.s|string|categorical"]
    for w in (Json0, Json1):
        text = w.stringify(w.output([Blank(), Ratings()]))
        assert read(text).write() == json.loads(text)
    with pytest.raises(ValueError):
        read('{"version": 7}')


def test_bootstrap_and_finder(spark, tmp_path, monkeypatch, capsys):
    text = cli.bootstrap(["namespace.featureName|double|Continuous|Feature description", "ns.kind|string|categorical"], "Customer")
    os.makedirs(tmp_path / "stubs")
    (tmp_path / "stubs/__init__.py").write_text("")
    (tmp_path / "stubs/mine.py").write_text(text)
    monkeypatch.syspath_prepend(str(tmp_path))
    (found,) = cli.find_sets("stubs")
    assert [(m.name, m.value_type, m.feature_type, m.description) for m in found.metadata] == [("kind", VT.STR, FT.NOMINAL, "Description for kind"), ("featureName", VT.DECIMAL, FT.CONTINUOUS, "Feature description")]
    assert cli.main(["metadata", "--json", "--version", "1", "stubs"]) == 0
    assert json.loads(capsys.readouterr().out)["version"] == 1
    assert cli.main(["metadata", "--psv", "stubs"]) == 0 and "namespace.featurename|bigdecimal|continuous" in capsys.readouterr().out
    for bad in ("a.b.c|int|continuous", "a.b|int", "a.b|float|continuous", "a.b|string|continuous", "a.b|double|categorical", "a.b|int|odd"):
        with pytest.raises(ValueError, match="line 1"):
            cli.bootstrap([bad], "X")


def test_generated_jobs_run(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "own_sets.py").write_text(
        "from factloom import FeatureSet, FeatureType as FT, From, Schema\n\n\n"
        "class MovieRatings(FeatureSet):\n    namespace, source = 'ns', From(Schema('Rating', 'movie_id string, rating int'))\n\n"
        "    def entity(self, r):\n        return r.movie_id\n\n"
        "    @property\n    def features(self):\n        return [self.builder.select(lambda r: r.rating).as_feature(FT.ORDINAL, 'R', 'Rating')]\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    assert cli.main(["jobs", "own_sets", "features", str(tmp_path / "out")]) == 0
    made = {}
    exec(capsys.readouterr().out, made)  # noqa: S102
    data = DataFrameSource(spark.createDataFrame([("1", 3), ("2", 5)], RATING.struct))
    assert made["movie_ratings"](data, context=CTX) == 0 and made["movie_ratings"](data, context=CTX) == -3
    assert lines(tmp_path / "out/movie_ratings") == ["1|R|3|2015-01-01", "2|R|5|2015-01-01"]
    assert sorted((r.entity, r.value) for r in spark.table("features.movie_ratings").collect()) == [("1", "3"), ("2", "5")]


def test_table_over_text_keeps_empty_strings_and_failures_leave_nothing(spark, tmp_path):
    facts = spark.createDataFrame([("a", "x", ""), ("b", "x", None), ("c", "x", " q\\E ")], "entity string, attribute string, value string")
    sink = sinks.TextSink("features", str(tmp_path / "t"), "kept", sinks.FixedSinkPartition.by_day("2015-01-01"), delimiter="$", encoder=lambda df: df)
    sink.write(facts, Rows())
    assert sorted(((r.entity, r.value) for r in spark.table("features.kept").collect()), key=repr) == [("a", ""), ("b", None), ("c", " q\\E ")]
    broken = facts.selectExpr("entity", "attribute", "IF(entity = 'c', raise_error('no'), value) AS value")
    parquet = sinks.ParquetSink("features", "broken", str(tmp_path / "p"), sinks.FixedSinkPartition.by_day("2015-01-01"), encoder=lambda df: df)
    for s in (parquet, sinks.TextSink("features", str(tmp_path / "p"), "broken_text", sinks.FixedSinkPartition.by_day("2015-01-01"), encoder=lambda df: df)):
        with pytest.raises(PySparkException):
            s.write(broken, Rows())
        assert not os.path.exists(tmp_path / "p") or [f for _, _, fs in os.walk(tmp_path / "p") for f in fs] == []


def test_stream_of_records(spark, tmp_path):
    from factloom import streaming

    spark.createDataFrame([("1", 3), ("2", 5)], RATING.struct).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(RATING.struct).parquet(str(tmp_path / "in"))
    q = streaming.start(stream, Rows(), CTX, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    want = eavt(Rows().generate(bound(spark, [("1", 3), ("2", 5)]).load(), CTX, encoded=True))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))
