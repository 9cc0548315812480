"""The queries of the data-processing problems over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import eventfeatures, instants, keystats, rejects, rolling, sketches, widetable
from factloom.queries import twins
from factloom.shared import table

KEYS = ["movie_id", "user_id"]
# One rating, however often it was delivered: all columns but its id and its arrival.
ONE_RATING = ["user_id", "movie_id", "rating", "timestamp", "origin"]
# Days since the last event count up to the last day of the year the data covers (2024-12-31).
AS_OF_DAY = 20_088


def _dated(spark: SparkSession, d: str):
    return lambda rows: instants.with_utc(rows, "timestamp", table(spark, d, "origins"), table(spark, d, "zone_names"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return keystats.heavy_keys(table(spark, d, "ratings"), KEYS, "rating").select("field", "key_value")


def p1_key_stats(spark: SparkSession, d: str) -> DataFrame:
    s = keystats.key_stats(table(spark, d, "ratings"), KEYS, "rating")
    return s.select("field", "key_value", "n_rows", "n_values", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    sources = {"ratings": (table(spark, d, "ratings"), "rating_id", "timestamp"), "eavt": (table(spark, d, "eavt"), "fact_id", "time")}
    return instants.instants(sources, table(spark, d, "origins"), table(spark, d, "zone_names"))


def p3_rolling(spark: SparkSession, d: str) -> DataFrame:
    daily = rolling.daily_totals(table(spark, d, "ratings"), "user_id", "rating", ONE_RATING, _dated(spark, d))
    return rolling.rolling_totals(daily, "user_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejected(rejects.parse_lines(table(spark, d, "rating_lines")))


def p4_valid_rows(spark: SparkSession, d: str) -> DataFrame:
    return rejects.valid(rejects.parse_lines(table(spark, d, "rating_lines")))


def _days(spark: SparkSession, d: str) -> DataFrame:
    return _dated(spark, d)(table(spark, d, "ratings").select(*ONE_RATING)).withColumn("day", F.date_from_unix_date(rolling.day_number(F.col("utc_ms"))))


def p5_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return sketches.DistinctCounts(spark).add(_days(spark, d), "day", "origin", ["user_id", "movie_id"]).report("day", "origin")


def p5_partials(spark: SparkSession, d: str) -> DataFrame:
    return sketches.partials(_days(spark, d), ["day", "origin"], ["user_id", "movie_id"])


def p5_within(spark: SparkSession, d: str) -> DataFrame:
    """The exact count of every group, and whether it lies within the stated bound of the estimate."""
    rows, none_day, none_origin = _days(spark, d), F.lit(None).cast("date"), F.lit(None).cast("string")
    grains = {"day": (F.col("day"), none_origin), "week": (F.trunc("day", "week"), none_origin), "year": (F.trunc("day", "year"), none_origin), "origin": (none_day, F.col("origin")), "day_origin": (F.col("day"), F.col("origin"))}
    keys = F.explode(F.array(*[F.struct(F.lit(g).alias("grain"), day.alias("day"), origin.alias("origin")) for g, (day, origin) in grains.items()]))
    ids = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("id")) for f in ("user_id", "movie_id")]))
    each = rows.select(keys.alias("g"), "user_id", "movie_id").select("g", ids.alias("x")).filter((F.col("g.day").isNotNull() | (F.col("g.grain") == "origin")) & F.col("x.id").isNotNull())
    exact = each.groupBy("g", "x.field").agg(F.count_distinct("x.id").alias("n")).select("g.*", "field", "n")
    got = p5_distinct_counts(spark, d).withColumnsRenamed({c: f"__{c}" for c in ("grain", "day", "origin", "field")})
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("grain", "day", "origin", "field")]
    both = exact.join(got, same[0] & same[1] & same[2] & same[3], "full")
    return both.select("grain", "day", "origin", "field", "n", F.coalesce(F.col("n").between(F.col("low"), F.col("high")), F.lit(False)).alias("within"))


def p6_features(spark: SparkSession, d: str) -> DataFrame:
    return eventfeatures.event_features(table(spark, d, "ratings"), "user_id", ["origin", "rating"], "rating", ONE_RATING, _dated(spark, d), AS_OF_DAY)


def p6_feature_rows(spark: SparkSession, d: str) -> DataFrame:
    """The features as rows: one for each user and each type, also those without a rating."""
    x = p6_features(spark, d).select("user_id", F.posexplode(F.arrays_zip("n", "days_since_last", "total")).alias("position", "x"))
    return x.select("user_id", "position", "x.n", "x.days_since_last", "x.total")


def p6_event_types(spark: SparkSession, d: str) -> DataFrame:
    types = eventfeatures.event_types(table(spark, d, "ratings"), ["origin", "rating"])
    return spark.createDataFrame([(i, *t) for i, t in enumerate(types)], "position int, origin string, rating int")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return instants.with_utc(table(spark, d, "eavt"), "time", table(spark, d, "origins"), table(spark, d, "zone_names"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return widetable.misfits(_facts(spark, d), table(spark, d, "feature_metadata")).select("entity", "attribute")


def p7_wide(spark: SparkSession, d: str) -> DataFrame:
    return widetable.wide_table(_facts(spark, d), table(spark, d, "feature_metadata"), beyond="decimals_beyond")


def p7_wide_values(spark: SparkSession, d: str) -> DataFrame:
    """The whole wide table: times as milliseconds since 1970, decimals as doubles."""
    w = p7_wide(spark, d).drop("decimals_beyond")
    plain = {"timestamp": lambda c: F.unix_millis(c), "decimal(38,18)": lambda c: F.round(c.cast("double"), 6), "double": lambda c: F.round(c, 9)}
    return w.select(*[plain.get(t, lambda c: c)(F.col(n)).alias(n.lower()) for n, t in w.dtypes])


QUERIES = {f.__name__: f for f in (p1_found, p1_key_stats, p2_found, p3_rolling, p4_found, p4_valid_rows, p5_distinct_counts, p5_partials, p5_within, p6_features, p6_feature_rows, p6_event_types, p7_found, p7_wide, p7_wide_values)}

# The attributes of feature_metadata by their declared type.
_GENRES = "action adventure animation childrens comedy crime documentary drama fantasy filmnoir horror musical mystery romance scifi thriller war western".split()
ATTRIBUTES = {
    "integral": [f"user_{g}_ratings" for g in _GENRES] + ["user_age", "user_total_ratings", "user_account_number", "movie_rating_count"],
    "floatingpoint": [f"user_{g}_avg" for g in _GENRES if g not in ("filmnoir", "western")] + ["user_rating_stddev", "user_recency_score", "movie_avg_rating", "rating_standard_deviation", "comedy_movie_avg_rating"],
    "decimal": ["user_credit", "user_spend", "user_last_invoice", "movie_box_office"],
    "date": ["user_join_date", "user_birth_date", "user_renewal_date", "movie_release_date"],
    "time": ["user_last_seen", "user_first_rating"],
    "bool": ["user_is_verified", "user_is_tall_screen", "user_has_consent", "movie_is_comedy"],
    "str": ["user_occupation", "user_segment", "user_zipcode", "user_note", "movie_title"],
}
# Of each type, what a value has to be, and the value as p7_wide_values gives it.
_FITS = {
    "str": "true",
    "integral": "regexp_full_match(v, '[+-]?[0-9]+') AND try_cast(v AS BIGINT) IS NOT NULL",
    "decimal": "regexp_full_match(v, '[+-]?[0-9]+([.][0-9]+)?(E[+-]?[0-9]+)?')",
    "floatingpoint": "regexp_full_match(v, '[+-]?[0-9]+([.][0-9]+)?(E[+-]?[0-9]+)?|NaN|[+-]?Infinity')",
    "bool": "lower(v) IN ('true', 'false')",
    "date": "regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(v AS DATE) IS NOT NULL",
    "time": "regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9][.][0-9]{3}[+-]([01][0-9]|2[0-3]):[0-5][0-9]') AND try_cast(substr(v, 1, 10) AS DATE) IS NOT NULL",
}
_FIT = "CASE value_type " + " ".join(f"WHEN '{t}' THEN {c}" for t, c in _FITS.items()) + " END"
_VALUES = {
    "str": "{}",
    "integral": "CAST({} AS BIGINT)",
    "decimal": "round(CAST(TRY_CAST({} AS DECIMAL(38, 18)) AS DOUBLE), 6)",
    "floatingpoint": "round(CAST({} AS DOUBLE), 9)",
    "bool": "CAST({} AS BOOLEAN)",
    "date": "CAST({} AS DATE)",
    "time": "epoch_ms(CAST({} AS TIMESTAMPTZ))",
}


def _wide_twin() -> str:
    latest = "max(CASE WHEN a = '{}' THEN v END)"
    cells = ", ".join(f"{_VALUES[t].format(latest.format(c))} AS {c}" for t, names in ATTRIBUTES.items() for c in names)
    return f"""
        WITH {twins.instants(twins.EAVT)},
        facts AS (
            SELECT entity, lower(m.attribute) AS a, value_type, CASE WHEN value <> '\\N' THEN trim(value, ' ') END AS v, coalesce(utc_ms, -1) AS moment, fact_id
            FROM eavt e JOIN feature_metadata m ON lower(trim(e.attribute)) = lower(m.attribute) LEFT JOIN inst ON fact_id = row_id),
        latest AS (SELECT entity, a, v FROM (SELECT *, row_number() OVER (PARTITION BY entity, a ORDER BY moment DESC, fact_id DESC) AS k FROM facts WHERE v IS NULL OR {_FIT}) WHERE k = 1),
        every AS (SELECT DISTINCT entity FROM eavt)
        SELECT every.entity, {cells} FROM every LEFT JOIN latest ON every.entity = latest.entity GROUP BY every.entity"""


ORACLES = {
    "p2_found": f"WITH {twins.instants(twins.RATINGS + ' UNION ALL ' + twins.EAVT)} SELECT table_name, row_id, utc_ms FROM inst",
    "p3_rolling": f"""
        WITH {twins.ONCE},
        daily AS (SELECT user_id, day, count(rating) AS n, coalesce(sum(rating), 0) AS s FROM once WHERE day IS NOT NULL GROUP BY user_id, day),
        span AS (SELECT user_id, unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS moment FROM daily GROUP BY user_id),
        every AS (SELECT span.user_id, CAST(moment AS DATE) AS day, coalesce(n, 0) AS n, coalesce(s, 0) AS s FROM span LEFT JOIN daily ON span.user_id = daily.user_id AND CAST(moment AS DATE) = daily.day),
        totals AS (
            SELECT user_id, day, CAST(sum(n) OVER a AS BIGINT) AS n_7, CAST(sum(s) OVER a AS DOUBLE) AS sum_7, CAST(sum(n) OVER b AS BIGINT) AS n_30, CAST(sum(s) OVER b AS DOUBLE) AS sum_30
            FROM every WINDOW a AS (PARTITION BY user_id ORDER BY day ROWS 6 PRECEDING), b AS (PARTITION BY user_id ORDER BY day ROWS 29 PRECEDING))
        SELECT user_id, day, n_7, sum_7, CASE WHEN n_7 > 0 THEN sum_7 / n_7 END AS mean_7, n_30, sum_30, CASE WHEN n_30 > 0 THEN sum_30 / n_30 END AS mean_30 FROM totals""",
    "p4_found": f"""
        WITH {twins.LINES}
        SELECT line_id, 'quoting' AS reason FROM w WHERE NOT quoted UNION ALL SELECT line_id, 'columns' FROM w WHERE quoted AND NOT four
        UNION ALL SELECT line_id, 'rating' FROM w WHERE four AND NOT rating_ok UNION ALL SELECT line_id, 'user_id' FROM w WHERE four AND NOT user_ok""",
    "p4_valid_rows": f"""
        WITH {twins.LINES}
        SELECT line_id, origin, trim(v1, ' ') AS user_id, v2 AS movie_id, CAST(trim(v3, ' ') AS INTEGER) AS rating, v4 AS timestamp FROM w WHERE four AND rating_ok AND user_ok""",
    "p6_feature_rows": f"""
        WITH {twins.ONCE},
        types AS (SELECT origin, rating, CAST(row_number() OVER (ORDER BY origin NULLS FIRST, rating NULLS FIRST) - 1 AS INTEGER) AS position FROM (SELECT DISTINCT origin, rating FROM ratings)),
        there AS (
            SELECT user_id, position, count(*) AS n, date_diff('day', max(day), DATE '2024-12-31') AS since, sum(once.rating) AS total
            FROM once JOIN types ON once.origin IS NOT DISTINCT FROM types.origin AND once.rating IS NOT DISTINCT FROM types.rating GROUP BY user_id, position)
        SELECT u.user_id, t.position, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(since AS INTEGER) AS days_since_last, CAST(coalesce(total, 0) AS BIGINT) AS total
        FROM (SELECT DISTINCT user_id FROM once) u CROSS JOIN types t LEFT JOIN there ON u.user_id = there.user_id AND t.position = there.position""",
    "p5_within": f"""
        WITH {twins.instants(twins.RATINGS)},
        rows_of AS (
            SELECT CAST(to_days(CAST(floor(utc_ms / 86400000) AS INTEGER)) + DATE '1970-01-01' AS DATE) AS day, origin, unnest(['user_id', 'movie_id']) AS field, unnest([user_id, movie_id]) AS id
            FROM ratings LEFT JOIN inst ON rating_id = row_id),
        grains AS (
            SELECT 'day' AS grain, day, NULL AS origin, field, id FROM rows_of WHERE day IS NOT NULL
            UNION ALL SELECT 'week', CAST(date_trunc('week', day) AS DATE), NULL, field, id FROM rows_of WHERE day IS NOT NULL
            UNION ALL SELECT 'year', CAST(date_trunc('year', day) AS DATE), NULL, field, id FROM rows_of WHERE day IS NOT NULL
            UNION ALL SELECT 'origin', NULL, origin, field, id FROM rows_of
            UNION ALL SELECT 'day_origin', day, origin, field, id FROM rows_of WHERE day IS NOT NULL)
        SELECT grain, day, origin, field, count(DISTINCT id) AS n, true AS within FROM grains WHERE id IS NOT NULL GROUP BY grain, day, origin, field""",
    "p7_wide_values": _wide_twin(),
    "p1_found": """
        WITH k AS (SELECT 'movie_id' AS field, movie_id AS key_value FROM ratings UNION ALL SELECT 'user_id', user_id FROM ratings)
        SELECT field, key_value FROM k WHERE key_value IS NOT NULL GROUP BY field, key_value
        HAVING count(*) * 1000 >= 25 * (SELECT count(*) FROM ratings)""",
    "p1_key_stats": """
        WITH k AS (SELECT 'movie_id' AS field, movie_id AS key_value, rating FROM ratings UNION ALL SELECT 'user_id', user_id, rating FROM ratings)
        SELECT field, key_value, count(*) AS n_rows, count(rating) AS n_values, round(avg(rating), 6) AS mean, round(stddev_pop(rating), 6) AS stddev
        FROM k WHERE key_value IS NOT NULL GROUP BY field, key_value""",
    "p6_event_types": """
        SELECT CAST(row_number() OVER (ORDER BY origin NULLS FIRST, rating NULLS FIRST) - 1 AS INTEGER) AS position, origin, rating
        FROM (SELECT DISTINCT origin, rating FROM ratings)""",
    "p7_found": """
        WITH v AS (
            SELECT e.entity, m.attribute, m.value_type, trim(e.value, ' ') AS v
            FROM eavt e JOIN feature_metadata m ON lower(trim(e.attribute)) = lower(m.attribute)
            WHERE e.value IS NOT NULL AND e.value <> '\\N')
        SELECT DISTINCT entity, attribute FROM v WHERE NOT """
    + _FIT,
}
