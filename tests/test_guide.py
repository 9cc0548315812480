"""Jobs of the guide with their golden output lines."""

import os

from factloom import AggregationFeatureSet, DataFrameSource, FeatureContext, FeatureSet, FeatureType as FT, From, Join, Schema, TextSource, agg, from_, join, join_multi, left_join
from factloom import sinks
from factloom.functions import datetimes as dt
from factloom.job import FeatureJobConfig, SimpleFeatureJob
from pyspark.sql import functions as F

CTX = FeatureContext(1_420_070_400_000)
MOVIE = Schema("Movie", "id string, title string, comedy int")
RATING = Schema("Rating", "movie_id string, rating int")
DIRECTOR = Schema("Director", "name string, movietitle string")
USER = Schema("User", "id string, age int")


def lines(path):
    return sorted(x for p, _, fs in os.walk(path) for f in fs if f.startswith("part") for x in open(os.path.join(p, f)).read().splitlines())


def run(tmp_path, name, bound, features):
    sink = sinks.TextSink("features", str(tmp_path / name), name, sinks.DerivedSinkPartition.eavt_by_day())
    assert SimpleFeatureJob.generate(FeatureJobConfig(bound, sink, CTX), features) == 0
    return lines(tmp_path / name)


def set_of(cls, source_, entity_, *features):
    s = cls()
    s.namespace, s.source, s.entity = "userguide", source_, entity_
    setattr(s, "features" if cls is FeatureSet else "aggregation_features", features)
    return s


def test_comedies_by_either_filter(spark, tmp_path):
    movies = DataFrameSource(spark.createDataFrame([("1", "a", 0), ("2", "b", 1)], MOVIE.struct))
    ratings = DataFrameSource(spark.createDataFrame([("1", 3), ("2", 2), ("2", 5)], RATING.struct))
    key, src = (lambda m, r: m.id), Join(MOVIE).to(RATING).on(lambda m: m.id, lambda r: r.movie_id)
    b = src.builder("userguide", key)
    mean = b.select(agg.avg(lambda m, r: r.rating))
    post = set_of(AggregationFeatureSet, src, key, mean.where(lambda m, r: m.comedy == 1).as_feature(FT.CONTINUOUS, "COMEDY_MOVIE_AVG_RATING", "d"))
    assert run(tmp_path, "post", src.bind(join(movies, ratings)), post) == ["2|COMEDY_MOVIE_AVG_RATING|3.5|2015-01-01"]
    pre = set_of(AggregationFeatureSet, src, key, mean.as_feature(FT.CONTINUOUS, "COMEDY_MOVIE_AVG_RATING_V2", "d"))
    assert run(tmp_path, "pre", src.bind(join(movies.where(lambda d: d.comedy == 1), ratings)), pre) == ["2|COMEDY_MOVIE_AVG_RATING_V2|3.5|2015-01-01"]


def test_directors(spark, tmp_path):
    (tmp_path / "directors.txt").write_text("Jim\tAir Bud (1997)\n\tFair Bud (1998)\nBob\tDracula (1931)\n")
    directors = TextSource([str(tmp_path / "directors.txt")], DIRECTOR, delimiter="\t").where(lambda d: d.name != "")
    movies = DataFrameSource(spark.createDataFrame([("1", "Air Bud (1997)", 0), ("2", "Fair Bud (1998)", 0)], MOVIE.struct))
    ratings = DataFrameSource(spark.createDataFrame([("1", 3), ("2", 2), ("2", 4)], RATING.struct))
    src = Join.multiway(DIRECTOR).inner(MOVIE).on(lambda d: d.movietitle, lambda m: m.title).inner(RATING).on(lambda d, m: m.id, lambda r: r.movie_id)
    key = lambda d, m, r: d.name
    s = set_of(AggregationFeatureSet, src, key, src.builder("userguide", key).select(agg.avg(lambda d, m, r: r.rating)).as_feature(FT.CONTINUOUS, "DIRECTOR_AVG_RATING", "d"))
    assert run(tmp_path, "directors", src.bind(join_multi(directors, movies, ratings)), s) == ["Jim|DIRECTOR_AVG_RATING|3.0|2015-01-01"]


def test_distinct_users(spark, tmp_path):
    users = DataFrameSource(spark.createDataFrame([("1", 20), ("1", 21), ("2", 30), ("2", 30)], USER.struct))
    src, key = From(USER), lambda u: u.id
    s = set_of(FeatureSet, src, key, src.builder("userguide", key).select(lambda u: F.lit(1)).as_feature(FT.DISCRETE, "USERS", "d"))
    assert run(tmp_path, "users", src.bind(from_(users.distinct_by(lambda d: d.id))), s) == ["1|USERS|1|2015-01-01", "2|USERS|1|2015-01-01"]


def test_left_join_counts_and_popular_ratings(spark, tmp_path):
    movies = DataFrameSource(spark.createDataFrame([("1", "a", 0), ("2", "b", 1), ("3", "c", 1)], MOVIE.struct))
    directors = DataFrameSource(spark.createDataFrame([("x", "a"), ("y", "a"), ("z", "c")], DIRECTOR.struct))
    src = Join.left(MOVIE).to(DIRECTOR).on(lambda m: m.title, lambda d: d.movietitle)
    key = lambda m, d: m.id
    b = src.builder("userguide", key)
    s = set_of(
        AggregationFeatureSet, src, key,
        b.select(agg.count(lambda m, d: d.is_defined)).as_feature(FT.DISCRETE, "DIRECTORS", "d"),
        b.select(agg.size()).where(lambda m, d: d.is_empty).as_feature(FT.DISCRETE, "UNKNOWN", "d"),
        b.select(agg.count()).having(lambda a: a.n > 1).as_feature(FT.DISCRETE, "POPULAR", "d"),
    )
    assert run(tmp_path, "left", src.bind(left_join(movies, directors)), s) == ["1|DIRECTORS|2|2015-01-01", "1|POPULAR|2|2015-01-01", "2|DIRECTORS|0|2015-01-01", "2|UNKNOWN|1|2015-01-01", "3|DIRECTORS|1|2015-01-01"]


def test_context_dates_and_record_time(spark, tmp_path):
    kind = Schema("Birth", "id string, born string")
    src = From(kind).with_context(Schema("Day", "day string"))
    key = lambda b, c: b.id

    class Ages(FeatureSet):
        namespace, source = "userguide", src

        def entity(self, b, c):
            return b.id

        def time(self, b, c, context):
            return F.unix_millis(F.to_timestamp(b.born))

        @property
        def features(self):
            years = lambda b, c: dt.difference(dt.parse_date(b.born), dt.parse_date(c.day))["years"]
            return [src.builder("userguide", key).select(years).as_feature(FT.CONTINUOUS, "AGE", "d")]

    births = DataFrameSource(spark.createDataFrame([("1", "1980-02-29"), ("2", "2000-12-31")], kind.struct))
    assert run(tmp_path, "ages", src.bind_with_context(from_(births), ("2015-01-01",)), Ages()) == ["1|AGE|34|1980-02-29", "2|AGE|14|2000-12-31"]
    assert os.path.exists(tmp_path / "ages/year=1980/month=02/day=29/_SUCCESS")


def test_the_readmes_example_runs(spark):
    import re

    readme = open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "README.md")).read()
    (code,) = re.findall(r"```python\n(.*?)```", readme, re.S)
    names = {"ratings": spark.createDataFrame([("m", i % 5 + 1) for i in range(20)] + [("few", 3), (None, 1)], RATING.struct)}
    exec(code, names)  # noqa: S102
    assert [tuple(r) for r in names["rows"].collect()] == [("m", "MEAN", "3.0", "2015-01-01")]
