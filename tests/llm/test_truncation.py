import re

import pytest

from factloom.llm import truncation

SCHEMA = "doc_id long, text string, source string, lang string"
FILL = [
    "The river pilots told the chamber that the flood relief would close. Nobody believed it.",
    "Whoever drew up the pages on the seed fund has plainly never stood in Lanevlund in January.",
    "They were led to it when the signal station ended in Lanalow.",
]
# text, and whether it was cut
CASES = [
    ("The river pilots told the chamber that the flood relief would close.", False),
    ("The river pilots told the chamber that the flood rel", True),
    ("The river pilots told the chamber that the", True),
    ("The river pilots told the chamber that the…", True),
    ("The river pilots told the chamber that the flo...", True),
    ("The river pilots told the chamber that the flood relief would close…", False),
    ("Nobody believed it. The river pilots told the chamber that the flood relief would close [...]", False),
    ("The river pilots told the chamber that the\n\n(ends)", True),
    ("Nobody believed it.\n■\n— 12 —", False),
    ("Nobody believed it. They were led\n[col. 370]", True),
    ("Nobody believed it. which brings me to—", False),
    ("Nobody believed it. [Laughter.]", False),
    ("Nobody believed it. [Laught", True),
    ("Nobody believed it. (A member: That is not so!", True),
    ("Nobody believed it, whatever Mrs.", True),
    ("Nobody believed it,", True),
    ("“Nobody believed it.”", False),
    ("Was anybody consulted?", False),
    ("12. Quaranlow Wages Bill — Second Reading", False),
    ("QUARANLOW TENANCY BILL: COMMITTEE STAGE", False),
    ("Business of the day: Rosilstead Wages Bill", False),
    ("AYES\nDunyn Seleefield\nGarwyn Nororanby\nNAYS\nAshir Gararanmarsh", False),
    ("Nobody believed it. Wir haben Kronen bewilligt, aber die F�", True),
    ("Nobody believed it. The lib-", True),
    ("Yes", True),
]


# The verdict rests on what the corpus shows: whole texts with the usual parts of a sitting.
SENTENCES = [
    "The river pilots of {} told Mrs. {} that the flood relief would close.",
    "Nobody in {} believed it, whatever Mr. {} says.",
    "They were led to it when Mrs. {} left {}.",
    "As the debate in {} made plain, the chamber heard {} with patience.",
    "Was anybody in {} consulted by {}?",
    "Aber die Kronen in {} haben wir {} bewilligt.",
    "I asked, before {} rose, what had become of {}.",
]
NAMES = [a + b for a in ("Lan", "Gar", "Ros", "Ul", "Kel", "Vel") for b in ("evlund", "imvik", "orby", "aton", "unden")]
NOTES = ["[Laughter.]", "(Applause)", "(A member: That is so!)", "[The bell rang.]"]


def corpus():
    out = []
    for i in range(700):
        parts = []
        for k in range(3 + i % 6):
            a, b = NAMES[(7 * i + k) % len(NAMES)], NAMES[(i + 11 * k) % len(NAMES)]
            parts.append(SENTENCES[(3 * i + 5 * k + i * k) % len(SENTENCES)].format(a, b))
            if (i + k) % 4 == 0:
                parts.append(NOTES[(i + 3 * k) % len(NOTES)])
        if i % 9 == 0:
            parts.append("damit komme ich zu—")
        text = " ".join(parts)
        text = f"{i}. {NAMES[i % 30]} Wages Bill — Second Reading\n" + text if i % 5 == 0 else text
        if i % 31 == 0:
            text = [f"{NAMES[i % 30]} Tenancy Bill: Committee Stage", f"{i}. {NAMES[i % 30]} Dues Bill — Second Reading", "AYES\n" + "\n".join(f"Ema {n}" for n in NAMES[i % 20 :])][i % 3]
        out.append(f"“{text}”" if i % 13 == 0 else text)
    return out


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(5000 + i, t, "corpus", "en") for i, t in enumerate(corpus())]
    rows += [(i, t, "s", "en") for i, (t, _) in enumerate(CASES)] + [(1000 + i, FILL[i % 3], "other", "en") for i in range(60)]
    rows += [(2000, "", "other", "en"), (2001, None, "other", None), (2002, "— 12 —", "other", "en"), (2003, "word " * 200_000 + "and the end.", "other", "en"), (2004, "   \n" * 50_000 + "It is so.", None, "en"), (2005, "■ \n" * 5_000, None, "en")]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_cases(documents):
    got = {r.doc_id for r in truncation.truncated(documents).collect()}
    wrong = [(t, i in got) for i, (t, cut) in enumerate(CASES) if cut != (i in got)]
    assert not wrong
    assert not got & set(range(1000, 3000))
    assert not got & set(range(5000, 6000))


def test_the_counts_decide(spark, documents):
    """A text without its closing mark is not cut where texts commonly end without one."""
    rows = [(i, f"{n} spoke of the flood relief", "s", "en") for i, n in enumerate(NAMES * 20)] + [(9_000, "They spoke of the flood relief.", "s", "en")]
    assert truncation.truncated(spark.createDataFrame(rows, SCHEMA)).count() == 0
    assert truncation.judged(documents, rare=0.0).filter("cut").count() < truncation.judged(documents).filter("cut").count()


def test_marks_without_limit(spark, documents):
    """No length of an end, a mark, a note or a repetition changes a verdict."""
    rows = [
        (1, "Nobody believed it. The river pilots told the" + "\n■ * * *\n(ends)" * 700 + "\n— 12 —", "s", "en"),
        (2, "Nobody believed it." + "\n■ * * *\n(ends)" * 700 + "\n— 12 —", "s", "en"),
        (3, "Nobody believed it. [A member: " + "that is not so at all, " * 400, "s", "en"),
        (4, "Nobody believed it. [A member: " + "that is not so at all, " * 400 + "and more.]", "s", "en"),
        (5, "The river pilots told the " + "w" * 5_000, "s", "en"),
        (6, "Nobody believed it. The river pilots told them that the flood relief would close" + "." * 3_000, "s", "en"),
    ]
    both = spark.createDataFrame(rows, SCHEMA).unionByName(documents.filter("doc_id >= 1000"))
    assert {r.doc_id for r in truncation.truncated(both).collect() if r.doc_id < 1000} == {1, 3, 5}


def test_dots_behind_an_abbreviation(spark, documents):
    """A full stop always follows a title, but it never ends a text there."""
    rows = [(1, "The river pilots told the chamber, whatever Mr...", "s", "en"), (2, "The river pilots told them that the flood relief would close...", "s", "en")]
    both = spark.createDataFrame(rows, SCHEMA).unionByName(documents.filter("doc_id >= 1000"))
    assert {r.doc_id for r in truncation.truncated(both).collect() if r.doc_id < 1000} == {1}


def test_twin_agrees_on_every_case(documents):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.register("documents", documents.toPandas())
    assert {r[0] for r in con.execute(truncation.twin()["truncated"]).fetchall()} == {r.doc_id for r in truncation.truncated(documents).collect()}


def test_repeated_rows_and_clashing_columns(spark, documents):
    extra = documents.selectExpr("*", "1 AS n", "'x' AS c", "'y' AS k1", "false AS cut")
    assert {r.doc_id for r in truncation.truncated(extra).collect()} == {r.doc_id for r in truncation.truncated(documents).collect()}
    twice = {r.source: (r.n_documents, r.n_cut) for r in truncation.by_source(documents.unionByName(documents)).collect()}
    once = {r.source: (r.n_documents, r.n_cut) for r in truncation.by_source(documents).collect()}
    assert {k: (a / 2, b / 2) for k, (a, b) in twice.items()} == once


def test_share_by_source_counts_all_documents(documents):
    got = {r.source: (r.n_documents, r.n_cut, r.share) for r in truncation.by_source(documents).collect()}
    cut = sum(c for _, c in CASES)
    assert got["s"] == (len(CASES), cut, round(cut / len(CASES), 6)) and got["other"] == (64, 0, 0.0) and got[None] == (2, 0, 0.0)


def test_own_ending_does_not_vouch_for_itself(spark):
    rows = [(1, "Nobody ever said that the wend...", "s", "en"), (2, FILL[0], "s", "en")]
    assert [r.doc_id for r in truncation.truncated(spark.createDataFrame(rows, SCHEMA)).collect()] == [1]


def test_empty_and_planted_cuts_are_found(spark, sf):
    assert truncation.truncated(spark.createDataFrame([], SCHEMA)).collect() == []
    d = spark.read.parquet(f"{sf}/documents.parquet")
    whole = [(r.doc_id, r.text, r.source) for r in d.collect() if r.text and len(r.text) > 300 and re.search(r"[a-z]{4,}[.?]$", r.text)]
    planted = [(i, t[: len(t) // 2 + k % 7] if k % 2 else t, s, "en") for k, (i, t, s) in enumerate(whole)]
    want = {i for k, (i, t, _) in enumerate(whole) if k % 2 and t[: len(t) // 2 + k % 7].rstrip()[-1].isalnum()}
    got = {r.doc_id for r in truncation.truncated(spark.createDataFrame(planted, SCHEMA)).collect()}
    assert want <= got and len(got - {i for k, (i, *_) in enumerate(whole) if k % 2}) == 0
