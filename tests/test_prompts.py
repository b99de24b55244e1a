"""Prompts, batched calls, last checks, reports, and questions answered with pins, rewrites and windows, by hand."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tessera.operators import layout, prompts
from tessera.plans.answering import ask, best_windows


def test_calls_are_batched_and_replayed(spark):
    def model(batch):
        assert 0 < len(batch) <= 4  # an assertion in a task fails the job
        return [f"{p}!" for p in batch]

    asked = spark.createDataFrame([(f"k{i % 10}", f"p{i % 10}") for i in range(40)] + [("k3", "p3")], "key string, prompt string").repartition(3)
    kept = spark.createDataFrame([("k1", "old"), ("k1", "older"), ("other", "x")], "key string, output string")
    out, kept = prompts.called(asked, kept, model, batch=4)
    got = {(r["key"], r["output"], r["asked"]) for r in out.collect()}
    assert got == {("k1", "old", False)} | {(f"k{i}", f"p{i}!", True) for i in range(10) if i != 1} and out.count() == 41
    again, _ = prompts.called(asked, kept, lambda batch: 1 / 0)
    assert {r["asked"] for r in again.collect()} == {False} and kept.count() == 11


def test_headed_texts(spark):
    rows = [("Law", "ITO", None, None, "149", "Salary", "t"), ("Rules", "ITR", "", "", "5", "", "t"), ("Cards", "WHT", None, "(3)", "7", "T", "t"), ("Law", "ITO", "First", None, None, "Part I", "t"), ("Law", "ITO", None, None, None, None, "t")]
    df = spark.createDataFrame(rows, "law string, law_code string, schedule string, clause string, section string, title string, text string")
    got = [r["h"] for r in df.select(prompts.headed_text(*[F.col(c) for c in df.columns]).alias("h")).collect()]
    assert got == ["Law — Section 149: Salary\nt", "Rules — Rule 5\nt", "Cards — Rate card, section (3): T\nt", "Law — Part I\nt", "Law — Section \nt"]


def test_citations_and_refusals(spark):
    row = spark.createDataFrame([(1, "c", "s", "L", "l", "t", 12, "http://x", date(2026, 6, 30))], "n int, chunk_id string, section_id string, law string, label string, text string, page int, url string, day date")
    c = row.select(prompts.citation_record(*[F.col(x) for x in row.columns]).alias("c")).first()["c"]
    assert (c["url"], c["version_date"], c["page"]) == ("http://x#page=12", "2026-06-30", 12)
    stages = spark.createDataFrame([("OUT_OF_SCOPE", True, 3), (None, False, 3), (None, None, 3), (None, True, 0), (None, True, None), (None, True, 1)], "reason string, answerable boolean, n int")
    got = [r["r"] for r in stages.select(prompts.last_checks(F.col("reason"), F.col("answerable"), F.col("n")).alias("r")).collect()]
    assert got == ["OUT_OF_SCOPE", "NOT_ANSWERABLE", "NOT_ANSWERABLE", "NO_VALID_CITATION", "NO_VALID_CITATION", None]


def test_reports_and_tables(spark):
    setups = spark.createDataFrame([(2, "b"), (1, "a"), (3, "none")], "ord int, setup string")
    reports = spark.createDataFrame([("a", "2026-01", 0.1, 0.2), ("a", "2026-02", 0.12345, None), ("b", "2025-01", 1.0, 0.5)], "setup string, report string, in_scope double, correct double")
    assert [tuple(r) for r in prompts.latest_correctness(setups, reports).orderBy("ord").collect()] == [(1, "a", "2026-02", 12.3, None), (2, "b", "2025-01", 100.0, 50.0)]
    rows = spark.createDataFrame([("x", None), ("x", "t"), ("y", "t")], "g string, s string")
    cells = {(r["g"], r["s"]): (r["n"], r["big"]) for r in prompts.cross_counts(rows, ["g", "s"], {"big": F.col("g") == "x"}).collect()}
    assert cells == {("x", "none"): (1, 1), ("x", "t"): (1, 1), ("y", "t"): (1, 0), ("x", "all"): (2, 2), ("y", "all"): (1, 0), ("all", "none"): (1, 1), ("all", "t"): (2, 1), ("all", "all"): (3, 2)}


def test_body_and_contents(spark):
    lines = spark.createDataFrame([(1, 10.0, 9.0, "Header"), (2, 10.0, 5.0, "small"), (3, 300.0, 9.0, "[ ] ;"), (4, 300.0, 9.0, "[a]"), (5, 790.0, 9.0, "Footer"), (6, 300.0, 60.0, "WATERMARK")], "i int, y double, size double, text string")
    assert {r["i"] for r in layout.body_lines(lines, 50.0, 780.0, 8.0, 40.0).collect()} == {2, 4}
    toc = spark.createDataFrame([([(1, "a"), (90, "page"), (2, "b"), (2, "again"), (52, "c"), (53, " The First Schedule "), (54, "no")],), ([],), ([(1, "Schedules")],)], "e array<struct<number:int,title:string>>")
    assert [[tuple(x) for x in r["c"]] for r in toc.select(layout.contents(F.col("e")).alias("c")).collect()] == [[(1, "a"), (2, "b"), (52, "c")], [], []]


CHUNK = "chunk_id string, section_id string, text string, tax_year_from int, tax_year_to int"


@pytest.fixture
def law(spark):
    chunks = spark.createDataFrame([
        ("s1", "L-s1", "salary income of every person", 2020, None), ("s2-1", "L-s2", "rental income from property", 2020, None), ("s2-2", "L-s2", "property dealers and agents", 2020, None), ("old", "L-s3", "salary income before", 2010, 2015), ("def", "L-s9", "imputable income means something", 2020, None), ("aim", "L-s8", "elsewhere it is said", 2020, None),
    ], CHUNK)
    sections = spark.createDataFrame([("section", str(i), f"L-s{i}") for i in (1, 2, 3, 8, 9)], "kind string, number string, section_id string")
    return chunks, sections


def test_pins_and_reasons(spark, law):
    chunks, sections = law
    questions = spark.createDataFrame([(1, "section 2 and salary income"), (2, "section 77"), (3, "section 77 or section 1"), (4, "salary in tax year 2012"), (5, "what is imputable income?"), (6, "salary in tax year 2002"), (7, ""), (8, "section 3 salary")], "question_id int, text string")
    terms = spark.createDataFrame([("imputable income", "28A", "def", "L-s8")], "term string, clause string, chunk_id string, points_to string")
    decisions, sources = ask(questions, chunks, sections, 2026, 2003, 2027, definitions=terms)
    reasons = {r["question_id"]: r["reason"] for r in decisions.collect()}
    assert reasons == {1: None, 2: "SECTION_NOT_FOUND", 3: None, 4: None, 5: None, 6: "TAX_YEAR_NOT_COVERED", 7: "NO_RELEVANT_SOURCES", 8: None}
    found = {}
    for r in sources.orderBy("rank").collect():
        found.setdefault(r["question_id"], []).append((r["chunk_id"], r["via"]))
    assert set(found[1][:2]) == {("s2-1", "lookup"), ("s2-2", "lookup")} and ("s1", "search") in found[1]
    assert found[3][0] == ("s1", "lookup") and {c for c, _ in found[4]} == {"old"}
    assert found[5][:2] == [("def", "lookup"), ("aim", "lookup")] and "old" not in {c for c, _ in found[8]}


def test_rewrites_named_sections_and_policy(spark, law):
    chunks, sections = law
    questions = spark.createDataFrame([(1, "tankhwah kitni"), (2, "nothing here matches")], "question_id int, text string")
    rewrites = spark.createDataFrame([(1, 1, "salary income person")], "question_id int, n int, text string")
    named = spark.createDataFrame([(2, 0, "L-s2"), (2, 1, "L-s3")], "question_id int, ord int, section_id string")
    top = {}
    for policy in ("question", "max"):
        _, sources = ask(questions, chunks, sections, 2026, 2003, 2027, rewrites=rewrites, named=named, policy=policy)
        rows = sources.collect()
        top[policy] = max(r["score"] for r in rows if r["question_id"] == 1)
        assert {r["chunk_id"] for r in rows if r["question_id"] == 2} >= {"s2-1", "s2-2"} and "old" not in {r["chunk_id"] for r in rows}
    assert top["question"] == 0.0 and top["max"] == 1.0


def test_windows(spark):
    text = "head " * 100 + "rare words stand here " + "tail " * 100
    docs = spark.createDataFrame([("long", text), ("short", "rare words"), ("none", "other " * 200)], "chunk_id string, text string")
    pairs = spark.createDataFrame([(1, "long"), (1, "short"), (1, "none")], "question_id int, chunk_id string")
    words = spark.createDataFrame([(1, "rare"), (1, "head")], "question_id int, w string")
    got = [tuple(r) for r in best_windows(docs, pairs, words, 200).collect()]
    assert len(got) == 1 and got[0][:2] == (1, "long") and "rare" in got[0][2] and len(got[0][2]) == 200
