"""DuckDB text of what several queries' twins share: instants, and fields of a quoted line."""

from __future__ import annotations

_FORMATS = (
    "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d", "%d-%b-%Y %H:%M:%S", "%d-%B-%Y %H:%M:%S", "%d %b %Y %H:%M:%S", "%d %B %Y %H:%M:%S",
    "%B %d, %Y %I:%M:%S %p", "%Y%m%dT%H%M%S", "%Y%m%d%H%M%S",
)
_ZONE = r"(Z|(?:UTC)?[+-][0-9]{2}:?[0-9]{2}| [A-Z]{3,4}| [A-Za-z]+/[A-Za-z_]+)$"


def instants(rows: str, name: str = "inst") -> str:
    """CTEs that end in ``name(table_name, row_id, utc_ms)`` of ``rows`` (table_name, row_id, text, origin)."""
    formats = ", ".join(f"'{f}'" for f in _FORMATS)
    order = " ".join(f"WHEN '{o}' THEN coalesce(try_strptime(base, '{f}/%Y %I:%M %p'), try_strptime(base, '{f}/%Y %H:%M'))" for o, f in (("dmy", "%d/%m"), ("mdy", "%m/%d")))
    return f"""
        {name}_rows AS (SELECT r.table_name, r.row_id, trim(r.text) AS t, o.tz_name, o.date_order FROM ({rows}) r LEFT JOIN origins o ON r.origin = o.origin WHERE r.text IS NOT NULL),
        {name}_zone AS (SELECT *, CASE WHEN (contains(t, ':') OR contains(t, 'T')) AND NOT regexp_matches(t, '[AP]M$') THEN regexp_extract(t, '{_ZONE}', 1) ELSE '' END AS z FROM {name}_rows),
        {name}_clock AS (SELECT *, regexp_replace(trim(left(t, length(t) - length(z))), '^[A-Z][a-z][a-z], ', '') AS c, regexp_replace(trim(z), '^UTC([+-])', '\\1') AS zone FROM {name}_zone),
        {name}_base AS (SELECT *, regexp_replace(c, '[.,][0-9]+$', '') AS base, regexp_extract(c, '[.,]([0-9]+)$', 1) AS frac FROM {name}_clock),
        {name}_wall AS (
            SELECT b.*, n.offset_min, coalesce(try_strptime(base, [{formats}]), CASE date_order {order} END) AS wall,
                CASE WHEN regexp_full_match(t, '[0-9]+([.][0-9]+)?') AND length(base) IN (10, 13, 16, 19)
                    THEN CAST(floor(CAST(t AS DECIMAL(38, 9)) * 1000 / CASE length(base) WHEN 10 THEN 1 WHEN 13 THEN 1000 WHEN 16 THEN 1000000 ELSE 1000000000 END) AS BIGINT) END AS counted
            FROM {name}_base b LEFT JOIN zone_names n ON b.zone = n.abbr),
        {name}_ms AS (
            SELECT *, epoch_ms(wall) AS w, CASE WHEN zone = '' THEN tz_name WHEN contains(zone, '/') THEN zone END AS region,
                CASE WHEN zone = 'Z' THEN 0 WHEN regexp_matches(zone, '^[+-]') THEN (CASE WHEN zone LIKE '-%' THEN -1 ELSE 1 END)
                    * (CAST(substr(zone, 2, 2) AS INTEGER) * 60 + CAST(right(zone, 2) AS INTEGER)) ELSE offset_min END AS minutes
            FROM {name}_wall),
        {name}_at AS (SELECT *, CASE WHEN region IS NOT NULL AND wall IS NOT NULL THEN epoch_ms(timezone(region, wall)) END AS late FROM {name}_ms),
        {name}_all AS (
            SELECT table_name, row_id, coalesce(counted, coalesce(w - minutes * 60000,
                -- of a wall clock that occurs twice, the first
                CASE WHEN timezone(region, make_timestamptz((late - 3600000) * 1000)) = wall THEN late - 3600000
                    WHEN timezone(region, make_timestamptz((late - 1800000) * 1000)) = wall THEN late - 1800000 ELSE late END)
                + CASE WHEN frac = '' THEN 0 ELSE CAST(left(frac || '000', 3) AS INTEGER) END) AS utc_ms, year(wall) AS written_in
            FROM {name}_at),
        {name} AS (SELECT table_name, row_id, CAST(utc_ms AS BIGINT) AS utc_ms FROM {name}_all WHERE (utc_ms >= 1704067200000 AND utc_ms < 1735689600000) OR written_in = 2024)"""


RATINGS = "SELECT 'ratings' AS table_name, rating_id AS row_id, timestamp AS text, origin FROM ratings"
EAVT = "SELECT 'eavt' AS table_name, fact_id AS row_id, time AS text, origin FROM eavt"

# One row per rating, however often it was delivered, with its UTC day (null where unreadable).
ONCE = f"""{instants(RATINGS)},
        once AS (
            SELECT user_id, movie_id, rating, origin, any_value(CAST(to_days(CAST(floor(utc_ms / 86400000) AS INTEGER)) + DATE '1970-01-01' AS DATE)) AS day
            FROM ratings LEFT JOIN inst ON rating_id = row_id WHERE user_id IS NOT NULL GROUP BY user_id, movie_id, rating, timestamp, origin)"""

_FIELD = r"(\"(?:[^\"]|\"\")*\"|[^\"\t][^\"\t]*|)"
_T = r"\t"


def _unquoted(i: int) -> str:
    x = f"f{i}"
    return f"CASE WHEN starts_with({x}, '\"') THEN replace(substr({x}, 2, length({x}) - 2), '\"\"', '\"') ELSE {x} END AS v{i}"


LINES = f"""
        l AS (SELECT line_id, origin, CASE WHEN ends_with(raw_line, chr(13)) THEN left(raw_line, length(raw_line) - 1) ELSE raw_line END AS line FROM rating_lines),
        f AS (SELECT *, regexp_full_match(line, '(?s){_FIELD}(?:{_T}{_FIELD})*') AS quoted, regexp_full_match(line, '(?s){_FIELD}{_T}{_FIELD}{_T}{_FIELD}{_T}{_FIELD}') AS four,
            {', '.join(f"regexp_extract(line, '(?s)^{_FIELD}{_T}{_FIELD}{_T}{_FIELD}{_T}{_FIELD}$', {i}) AS f{i}" for i in (1, 2, 3, 4))} FROM l),
        v AS (SELECT *, {', '.join(_unquoted(i) for i in (1, 2, 3, 4))} FROM f),
        w AS (SELECT *, regexp_full_match(trim(v3, ' '), '[1-5]') AS rating_ok, regexp_full_match(trim(v1, ' '), '[0-9]{{1,12}}') AS user_ok FROM v)"""
