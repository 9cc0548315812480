"""Texts that stop before they end, by word trigrams inside texts versus at ends, in pure SQL.

A text is rewritten as tokens: words, marks, and one token each for what stands in a bracketed
note and for the words of lines that hold names alone. For each run of three tokens the corpus
is counted twice: how often it goes on inside a text and how often it ends one. A text whose
last trigram is frequent inside texts but almost never terminal was cut. Nothing else decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.shared import written

# Patterns and replacements in the syntax that Java's regular expressions share with RE2.
# End marks, page footers and dots of omission. Marks and dots are rewritten as one
# sign (a stray word inside a mark is allowed for); a footer has a line of its own. Behind each
# pattern stands what a text holds in which it can match at all.
END_MARKS = r"\*\s*(?:\p{Ll}{1,9}\s*)?\*\s*(?:\p{Ll}{1,9}\s*)?\*|\(ends\)|\[ends?\]|#{2,}|-30-", "■", ("*", "ends)", "[end", "##", "-30-")
DOTS = r"\[ ?(?:…|\.{3,}) ?\]|\( ?(?:…|\.{3,}) ?\)|\.{3,}|\. \.[ .]*", "…", ("…", "...", ". .")
FOOTER = r"^[ \t■]*(?:[—–-] ?\d+ ?[—–-]|\[col\. ?(?:\p{Ll}{1,9} )?\d+\]|\[?[Pp](?:age|\.) ?\d+\]?)[ \t■\r]*$"
# Closed notes (also one within another), then a note that is still open at the end, then lines.
NOTES = (
    (r"[\[(][^\[\]()]*[\])]", " ⟦ ⟦ ⟦ ⟧ "),
    (r"[\[(][^\[\]()]*[\])]", " ⟦ ⟦ ⟦ ⟧ "),
    (r"[\[(][^\[\]()]*$", " ⟦ ⟦ ⟦ "),
    (r"\n\s*", "\n"),
)
# How a line of names, a heading or an entry of a list starts, and what none of them holds.
NAMES_START = r"^\s*[\p{Lu}\p{N}]"
NAMES_LACK = r"(?:^|[^\p{L}\p{N}])\p{Ll}{5,}|\p{L}{2}[.!?…]|[;?!“”«»\x22⟦⟧…]"
NAME = (r"[\p{L}\p{N}.\x27’]+", "¶")
# Marks of one kind become one token.
ALIKE = (("''", "’"), ("’", "’ "), ("!", "?"), (";", ":"), ("–", "—"), ("»", "”"), ("«", "“"), ("„", "“"), ("…", "."))
MARKS = (
    (r"\x22([\p{L}\p{N}])", r" “ \1"),
    (r"\x22", "”"),
    (r"\.(\p{Ll})\.", r"\1."),
    (r"[^a-z \p{L}\p{N}.?,:—“”’⟦⟧¶-]+", " "),
    (r"([.?,:—“”]) *", r" \1 "),
    (r" {2,}", " "),
    (r" -+", " "),
)
CLASSES = ((r" \p{Lu}[^ ]*", " A"), (r" \p{N}[^ ]*", " #"))


class _Spark:
    """The functions that Spark's SQL and DuckDB's (the twin's) name differently."""

    any_hash, cr, newline, split, blanks = "xxhash64", r"'\r'", r"'\n'", "split", r"' \t\r\n■'"

    def replaced(self, x: str, steps) -> str:
        for pattern, by in steps:
            by = by.replace("\\", "$")
            x = f"regexp_replace({x}, r'{pattern}', '{by}')"
        return x

    def signed(self, x: str, pattern: str, by: str, where: tuple[str, ...]) -> str:
        """``replaced`` of the texts that hold any of ``where``, which is found far sooner."""
        return f"CASE WHEN {' OR '.join(f"contains({x}, '{w}')" for w in where)} THEN {self.replaced(x, ((pattern, by),))} ELSE {x} END"

    def stripped(self, x: str, more: str = "") -> str:
        return f"trim(TRAILING {self.blanks[:-1]}{more}' FROM {x})"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp({x}, r'{pattern}')"

    def without_lines(self, x: str, pattern: str) -> str:
        return f"array_join(filter(split({x}, {self.newline}), l -> NOT {self.matches('l', pattern)}), {self.newline})"

    def per_line(self, of) -> str:
        return f"array_join(transform(lines, (x, i) -> {of('x', 'i = 0', 'get(lines, i - 1)')}), ' ')"

    positions = """
        SELECT inline(arrays_zip(slice(k, 1, n), slice(k, 2, n), slice(t, 2, n), slice(t, 3, n), slice(t, 4, n), concat(array_repeat(nullif(whose, whose), n - 1), array(whose))))
        AS (k1, k2, before, t, following, own)
        FROM (SELECT *, size(t) - 2 AS n FROM (SELECT named_struct('doc_id', doc_id, 'source', source, 'h', h, 'dotted', dotted) AS whose, split(s, ' ') AS t, split(classes, ' ') AS k FROM classed))"""


class _Duck(_Spark):
    any_hash, cr, newline, split, blanks = "hash", "chr(13)", "chr(10)", "string_split", "' ' || chr(9) || chr(13) || chr(10) || '■'"

    def replaced(self, x: str, steps) -> str:
        for pattern, by in steps:
            x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
        return x

    def stripped(self, x: str, more: str = "") -> str:
        return f"rtrim({x}, {self.blanks[:-1]}{more}')"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def without_lines(self, x: str, pattern: str) -> str:
        return f"array_to_string(list_filter(string_split({x}, {self.newline}), lambda l: NOT {self.matches('l', pattern)}), {self.newline})"

    def per_line(self, of) -> str:
        return f"array_to_string(list_transform(lines, lambda x, i: {of('x', 'i = 1', 'lines[i - 1]')}), ' ')"

    positions = """
        SELECT k[i] AS k1, k[i + 1] AS k2, t[i + 1] AS before, t[i + 2] AS t, t[i + 3] AS following, CASE WHEN i = len(t) - 2 THEN whose END AS own
        FROM (SELECT *, unnest(range(1, len(t) - 1)) AS i FROM (SELECT {'doc_id': doc_id, 'source': source, 'h': h, 'dotted': dotted} AS whose, string_split(s, ' ') AS t, string_split(classes, ' ') AS k FROM classed))"""


def _counted(q: _Spark, documents: str) -> str:
    """One row for each trigram inside texts (``doc_id`` null) and one for each text's last one.

    One word over and over tells nothing of how texts go on: such trigrams are left out.
    """

    def names(line: str) -> str:
        return f"({q.matches(line, NAMES_START)} AND NOT {q.matches(line, NAMES_LACK)})"

    def line(x: str, first: str, before: str) -> str:
        return f"CASE WHEN {names(x)} AND ({first} OR {names(before)}) THEN {q.replaced(x, (NAME,))} ELSE {x} END"

    alike = "x"
    for a, b in ALIKE:
        alike = f"replace({alike}, '{a}', '{b}')"
    return f"""
        WITH joined AS (SELECT doc_id, source, {q.any_hash}(text) AS h, replace(replace(text, '-' || {q.cr} || {q.newline}, ''), '-' || {q.newline}, '') AS x FROM {documents} WHERE length(text) > 0),
        marked_off AS (SELECT doc_id, source, h, {q.signed('x', *END_MARKS)} AS x FROM joined),
        dotted_off AS (SELECT doc_id, source, h, {q.signed('x', *DOTS)} AS x FROM (SELECT doc_id, source, h, {q.without_lines('x', FOOTER)} AS x FROM marked_off) f),
        stripped AS (SELECT doc_id, source, h, {q.stripped('x')} AS core, {q.stripped('x', '…')} AS bare FROM dotted_off),
        noted AS (SELECT doc_id, source, h, core LIKE '%…' AND NOT {q.matches('bare', r'[.!?][^\p{L}\p{N}]*$')} AS dotted, {q.replaced(f"replace(bare, {q.cr}, {q.newline})", NOTES)} AS x FROM stripped),
        in_lines AS (SELECT doc_id, source, h, dotted, {q.split}(x, {q.newline}) AS lines FROM noted),
        named AS (SELECT doc_id, source, h, dotted, {q.per_line(line)} AS x FROM in_lines),
        marked AS (SELECT doc_id, source, h, dotted, {q.replaced(alike, MARKS)} AS x FROM named),
        tokens AS (SELECT doc_id, source, h, dotted, trim('^ ^ ' || trim(x)) AS s FROM marked),
        classed AS (SELECT *, {q.replaced('s', CLASSES)} AS classes FROM tokens),
        positions AS ({q.positions}),
        trigrams AS (
            SELECT k1, k2, CASE WHEN t IN ('.', '?') THEN before || t ELSE t END AS c, own, following IN ('.', '?') AS closes
            FROM positions WHERE t IS NOT NULL AND (following IS NULL OR k1 <> k2 OR before <> t OR lower(t) = upper(t)))
        SELECT k1, k2, c, own IS NOT NULL AS is_end, own.doc_id AS doc_id, own.source AS source, own.h AS h, own.dotted AS dotted, n, n_close
        FROM (SELECT k1, k2, c, own, count(*) AS n, count(CASE WHEN closes THEN 1 END) AS n_close FROM trigrams GROUP BY k1, k2, c, own) g"""


def _totals(q: _Spark, counted: str) -> str:
    """One row for each trigram: its classes, its count, that before a closing mark, and that at
    ends of different texts."""

    def of(k: str) -> str:
        return f"CASE WHEN {k} <> 'A' AND {q.matches(k, r'^\p{L}')} THEN 'w' ELSE {k} END"

    return f"""
        WITH ends AS (SELECT k1, k2, c, h FROM {counted} WHERE is_end GROUP BY k1, k2, c, h),
        both_of AS (
            SELECT k1, k2, c, n, n_close, 0 AS e FROM {counted} WHERE NOT is_end
            UNION ALL SELECT k1, k2, c, 0 AS n, 0 AS n_close, 1 AS e FROM ends)
        SELECT k1, k2, c, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(n_close) AS DOUBLE) AS s, CAST(sum(e) AS DOUBLE) AS e, {of('k1')} AS g1, {of('k2')} AS g2,
        CASE WHEN c LIKE '%.' THEN '.' WHEN c LIKE '%?' THEN '?' WHEN {q.matches('c', r'^\p{Lu}')} THEN 'A' WHEN {q.matches('c', r'^\p{L}')} THEN 'w' WHEN {q.matches('c', r'^\p{N}')} THEN '#' ELSE c END AS g3
        FROM both_of GROUP BY k1, k2, c"""


def _judged(counted: str, totals: str, rare: float) -> str:
    """``doc_id, source, n, cut`` of every text.

    End rates are occurrences at ends to all occurrences, close rates those before a closing
    mark. Each is estimated from coarse to fine (any token; the last token's class; then the
    classes of all three for words, the last word with its mark and at last the trigram itself
    for marks), a finer estimate being drawn to the coarser one as if one more end had been
    seen at the coarser rate (ten more for words, whose classes tell little); a text's own end
    is taken off.
    """
    own = "(greatest({0} - 1, 0) + 1e0)"
    return f"""
        WITH of_classes AS (SELECT g1, g2, g3, sum(n) AS n2, sum(s) AS c2, sum(e) AS e2 FROM {totals} GROUP BY g1, g2, g3),
        of_class AS (SELECT g3, sum(n2) AS n1, sum(c2) AS c1, sum(e2) AS e1 FROM of_classes GROUP BY g3),
        of_all AS (SELECT sum(e1) / (sum(n1) + sum(e1)) AS r0, sum(c1) / sum(n1) AS s0 FROM of_class),
        rates1 AS (SELECT *, {own.format('e1')} / (n1 + e1 + 1e0 / r0) AS r1, (c1 + 1e0) / (n1 + 1e0 / s0) AS s1 FROM (SELECT *, (SELECT r0 FROM of_all) AS r0, (SELECT s0 FROM of_all) AS s0 FROM of_class) o),
        rates2 AS (SELECT *, (greatest(e2 - 1, 0) + 1e1) / (n2 + e2 + 1e1 / r1) AS r2, (c2 + 1e0) / (n2 + 1e0 / s1) AS s2 FROM of_classes JOIN rates1 USING (g3)),
        of_last AS (SELECT c, sum(n) AS n3, sum(s) AS c3, sum(e) AS e3 FROM {totals} GROUP BY c),
        stopped AS (SELECT c AS with_stop, (e3 + 1e0) / (n3 + e3 + 1e0 / (SELECT r1 FROM rates1 WHERE g3 = '.')) AS r_stop FROM of_last WHERE c LIKE '%.'),
        verdicts AS (
            SELECT k1, k2, x.c, CASE WHEN g3 IN ('w', 'A', '#') THEN r2 ELSE {own.format('e')} / (n + e + (n3 + e3 + 1e0 / r1) / {own.format('e3')}) END < {rare} * r0 AS cut,
            n3 = 0 OR (s + 1e0) / (n + (n3 + 1e0 / s2) / (c3 + 1e0)) < {rare} * s0 OR coalesce(r_stop < {rare} * r0, false) AS cut_dotted
            FROM (SELECT *, c || '.' AS with_stop FROM {totals} WHERE e > 0) x JOIN of_last ON x.c = of_last.c JOIN rates2 USING (g1, g2, g3) LEFT JOIN stopped USING (with_stop))
        SELECT doc_id, source, t.n, CASE WHEN dotted THEN cut_dotted ELSE cut END AS cut
        FROM (SELECT * FROM {counted} WHERE is_end) t JOIN verdicts USING (k1, k2, c)"""


def judged(documents: DataFrame, rare: float = 0.6) -> DataFrame:
    """``doc_id, source, n, cut`` for every non-empty text; ``n`` equal rows come out as one.

    "Almost never terminal" is: at ends less often, by the factor ``rare``, than a trigram is on
    average. Where dots stand at the end, a sentence may close there: then the trigram counts as
    almost never terminal if a closing mark follows it that seldom, if its last word with a full
    stop ends texts that seldom, or if that word occurs nowhere inside a text.

    Defined results: null and empty texts have no row; end marks and page footers are no part of
    a text, and one that holds nothing else is not cut; equal texts count once among the ends,
    and never for themselves; in a corpus too small to tell, a text is not cut.
    """
    spark: SparkSession = documents.sparkSession
    needed = documents.selectExpr("doc_id", "source", "CAST(text AS STRING) AS text")
    run = lambda sql, **frames: spark.sql(sql.replace("{", "{{").replace("}", "}}").replace("@documents", "{documents}").replace("@counted", "{counted}").replace("@totals", "{totals}"), **frames)
    # several counts come from these tables; recomputed, the texts would be taken apart each time
    counted = written(run(_counted(_Spark(), "@documents"), documents=needed), "trigrams")
    totals = written(run(_totals(_Spark(), "@counted"), counted=counted), "trigram-totals")
    return run(_judged("@counted", "@totals", rare), counted=counted, totals=totals)


def truncated(documents: DataFrame) -> DataFrame:
    """``doc_id`` of every text that was cut."""
    return judged(documents).filter("cut").select("doc_id").distinct()


def by_source(documents: DataFrame) -> DataFrame:
    """``source, n_documents, n_cut, share``: cut documents of all documents (empty ones included)."""
    run = documents.sparkSession.sql
    return run(_BY_SOURCE.format(documents="{documents}", judged="{judged}"), documents=documents.select("source"), judged=judged(documents))


_BY_SOURCE = """
    SELECT source, n_documents, coalesce(n_cut, 0) AS n_cut, round(CAST(coalesce(n_cut, 0) AS DOUBLE) / n_documents, 6) AS share
    FROM (SELECT source, count(*) AS n_documents FROM {documents} GROUP BY source) a
    LEFT JOIN (SELECT source AS s, CAST(sum(n) AS BIGINT) AS n_cut FROM {judged} WHERE cut GROUP BY source) b ON a.source IS NOT DISTINCT FROM b.s"""


def twin(rare: float = 0.6) -> dict[str, str]:
    """The same query as DuckDB runs it, over the view ``documents``."""
    rows = f"(WITH counted AS MATERIALIZED ({_counted(_Duck(), 'documents')}), totals AS MATERIALIZED ({_totals(_Duck(), 'counted')}), judged AS ({_judged('counted', 'totals', rare)}) SELECT * FROM judged)"
    return {"truncated": f"SELECT DISTINCT doc_id FROM {rows} WHERE cut", "by_source": _BY_SOURCE.format(documents="documents", judged=rows)}
