"""Structure of laws: cases by hand, and block scans against plain windows."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import sizes
from tessera.operators import structure as s
from tessera.operators.ordered import fill_down

LINE = "law string, page int, ord long, text string, bold boolean, centred boolean"


def lines(spark, *rows):
    return spark.createDataFrame([("L", page, i, text, bold, centred) for i, (page, text, bold, centred) in enumerate(rows)], LINE)


def reads(result):
    """How often a result's plan reads the rows that were given."""
    return result._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")


def test_levels_read_lines_once(spark):
    rows = lines(spark, (1, "PART V", True, True), (1, "147. Advance tax.—(1) Every", True, False))
    assert reads(rows) == 1
    assert reads(s.section_levels(rows, spark.createDataFrame([("L", 1, "CHAPTER X")], "law string, page int, header string"))) == 0


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_block_scan(spark, block):
    rows = spark.range(300).select((F.col("id") % 2).alias("g"), "id", F.when(F.col("id") % 11 == 3, F.col("id")).alias("v"), F.lit(1).alias("__v"))
    want = fill_down(rows, ["g"], ["id"], "v", "last")
    got = s.carried(rows, ["g"], "id", {"last": F.col("v")}, block)
    assert got.columns == ["g", "id", "v", "__v", "last"]
    assert sorted((r["id"], r["last"]) for r in got.collect()) == sorted((r["id"], r["last"]) for r in want.collect())


def test_levels(spark):
    rows = lines(
        spark, (1, "PART V", True, True), (1, "ADVANCE TAX AND", True, True), (1, "DEDUCTION OF TAX AT SOURCE", True, True), (1, "Division I", True, True), (1, "ADVANCE TAX PAID BY THE TAXPAYER", True, True), (1, "147. Advance tax.—(1) Every", True, False), (1, "TITLE AFTER A SECTION", True, True),
        (1, "Division III Deduction of Tax", True, True), (2, "149. Salary.—(1) Every", True, False), (2, "12. Too small.—x", True, False), (2, "150. Dividends.—x", True, False), (3, "151. Profit.—x", True, False), (3, "PART II", False, False), (3, "152. Other.—x", True, False),
    )
    pages = spark.createDataFrame([("L", 1, "CHAPTER X"), ("L", 2, "and so on"), ("L", 3, "CHAPTER XI")], "law string, page int, header string")
    got = [tuple(r) for r in s.section_levels(rows, pages).orderBy("ord").select("section", "chapter", "part").collect()]
    part = "Part V: Advance Tax and — Deduction of Tax at Source"
    assert got == [
        ("147", "CHAPTER X", f"{part}; Division I: Advance Tax Paid by the Taxpayer"), ("149", "CHAPTER X", f"{part}; Division III: Deduction of Tax"), ("150", "CHAPTER X", f"{part}; Division III: Deduction of Tax"),
        ("151", "CHAPTER XI", None), ("152", "CHAPTER XI", "Part II"),
    ]
    assert s.section_levels(rows.limit(0), pages).collect() == []


def test_levels_of_many_lines_are_not_broadcast(spark, monkeypatch):
    for name in ("small", "joined_as"):
        monkeypatch.setattr(s, name, lambda df, f=getattr(sizes, name): f(df, -1), raising=False)  # no table counts as small
    rows = lines(spark, (1, "PART V", True, True), (1, "OF TAX", True, True), (1, "147. Tax.—x", True, False), (2, "Division I", True, True), (2, "OF RATES", True, True), (2, "148. Rate.—x", True, False), (3, "149. Other.—x", True, False))
    pages = spark.createDataFrame([("L", 1, "CHAPTER X"), ("L", 2, "and so on"), ("L", 3, "CHAPTER XI")], "law string, page int, header string")
    found = s.section_levels(rows, pages)
    got = sorted((r["section"], r["chapter"], r["part"]) for r in found.collect())
    assert got == [("147", "CHAPTER X", "Part V: Of Tax"), ("148", "CHAPTER X", "Part V: Of Tax; Division I: Of Rates"), ("149", "CHAPTER XI", None)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_tables_go_on(spark):
    rows = spark.createDataFrame([
        ("L", 1, 1, "text", "The rates are as fol-"), ("L", 2, 1, "text", "lows"), ("L", 3, 1, "table", "| A |\n|---|\n| 1 |"), ("L", 4, 2, "table", "| A |\n|---|\n| 2 |"), ("L", 5, 3, "table", "| 3 |\n|---|\n| 4 |"), ("L", 6, 3, "table", "| A |\n|---|\n| 5 |"),
        ("L", 7, 5, "table", "| A |\n|---|\n| 6 |"), ("L", 8, 5, "text", "[ ]"), ("L", 9, 5, "text", "after it"), ("L", 10, 6, "text", "(a) an item"), ("L", 11, 6, "text", "Provided that"),
    ], "law string, ord long, page int, kind string, text string")
    got = [tuple(r) for r in s.paragraphs_and_tables(rows, ["law"]).orderBy("para").select("is_table", "text", "page", "page_end").collect()]
    assert got == [
        (False, "The rates are as fol-lows", 1, 1), (True, "| A |\n|---|\n| 1 |\n| 2 |\n| 3 |\n| 4 |", 1, 3), (True, "| A |\n|---|\n| 5 |", 3, 3), (True, "| A |\n|---|\n| 6 |", 5, 5), (False, "after it", 5, 5), (False, "(a) an item", 6, 6), (False, "Provided that", 6, 6),
    ]


def test_schedules_read_lines_once(spark):
    rows = lines(spark, (0, "Division II", True, True), (0, "rates", False, False))
    assert reads(s.schedule_units(rows, spark.createDataFrame([("L", 0, "First Schedule")], "law string, page int, header string"), "X")) == 0


def test_grids_read_rows_once(spark):
    rows = spark.createDataFrame([("g", i, ["a", "b"]) for i in range(3)], "grid string, row long, cells array<string>")
    assert reads(s.grid_tables(rows, "grid", "row", "cells")) == 1


def test_grids(spark):
    long = "The following table holds the rates of tax for all of the persons that are named"
    cells = [["S.No", None, "Rate"], ["1", "", "1[5%]"], [None, None], [long], ["short"], ["S.No", "Rate"], ["2.5[x]", "a12[y]"], ["S.No", "Rate"], ["3", "7"], ["alone"]]
    rows = spark.createDataFrame([("g", i, c) for i, c in enumerate(cells)], "grid string, row long, cells array<string>")
    got = [(r["n"], r["caption"], r["rows"]) for r in s.grid_tables(rows, "grid", "row", "cells").orderBy("n").collect()]
    assert got == [(1, None, [["S.No", "Rate"], ["1", "[5%]"]]), (2, long, [["short"], ["S.No", "Rate"], ["2.5[x]", "a12[y]"], ["S.No", "Rate"], ["3", "7"], ["alone"]])]
    assert s.grid_tables(rows.filter("row IN (3, 4)"), "grid", "row", "cells").collect() == []


def test_spans(spark):
    spans = spark.createDataFrame([
        (1, 10.0, 14.0, 6.0, False, "12"), (1, 15.0, 40.0, 10.0, True, "Salary"), (1, 40.5, 60.0, 10.0, False, "means"), (1, 60.0, 63.0, 6.5, False, " 3 "), (1, 70.0, 90.0, 10.0, False, "pay"), (2, 1.0, 3.0, 6.0, False, "4"), (2, 4.0, 9.0, 10.0, False, "[text"), (3, 1.0, 3.0, 9.5, True, "5"), (3, 5.0, 9.0, 10.0, False, "words"), (4, 1.0, 2.0, 10.0, True, " "),
    ], "line int, x0 double, x1 double, size double, bold boolean, text string")
    got = {r["line"]: tuple(r)[1:] for r in s.marker_spans(spans, ["line"]).collect()}
    assert got == {1: ("Salarymeans pay", ["12", "3"], True, True), 2: ("[text", ["4"], False, False), 3: ("5 words", [], False, True)}
    assert {(r["line"], r["marker"], r["owner"]) for r in s.marker_owners(spans, ["line"]).collect()} == {(1, "12", None), (1, "3", "means"), (2, "4", None)}


def test_schedules(spark):
    headers = ["FIRST SCHEDULE – Part I", "First Schedule", "The Second Schedule", "Second Schedule Part - II", "second schedule", "Zeroth Schedule", "Twelfth Schedule"]
    got = [tuple(r["s"]) if r["s"] else None for r in spark.createDataFrame([(h,) for h in headers], "h string").select(s.schedule_of(F.col("h")).alias("s")).collect()]
    assert got == [("First Schedule", 1, "Part I"), ("First Schedule", 1, None), None, ("Second Schedule", 2, "Part II"), ("Second Schedule", 2, None), None, ("Twelfth Schedule", 12, None)]
    pages = spark.createDataFrame([("L", i, h) for i, h in enumerate(headers)], "law string, page int, header string")
    rows = lines(spark, (0, "Division II", True, True), (0, "rates", False, False), (1, "go on", False, False), (3, "intro", False, False), (3, "(5) Exempt income", True, False), (4, "more", False, False), (4, "(3) not a clause", True, False), (4, "(6A) Pension", True, False), (5, "nothing", False, False), (6, "(1) plain", True, False))
    assert [(r["ord"], r["unit"]) for r in s.schedule_units(rows, pages, "X").orderBy("ord").collect()] == [(0, "X-sch1-pI-divII"), (1, "X-sch1-pI-divII"), (2, "X-sch1-pI-divII"), (3, "X-sch2-pII"), (4, "X-sch2-pII-cl5"), (5, "X-sch2-pII-cl5"), (6, "X-sch2-pII-cl5"), (7, "X-sch2-pII-cl6A"), (9, "X-sch12")]


def test_sentences(spark):
    df = spark.createDataFrame([(1, "One two. Three; four: five."), (2, "x" * 100 + ". Y."), (3, "")], "id int, text string")
    got = sorted(tuple(r) for r in s.sentence_pieces(df, ["id"], "text", 4).collect())
    assert got == [(1, 0, "One two. Three;"), (1, 1, "four: five."), (2, 0, "x" * 100 + "."), (2, 1, "Y.")]
    headed = s.with_titles(spark.createDataFrame([("4A", "Tax", 0, "a"), ("4A", "Tax", 1, "b"), ("5", None, 1, "c")], "section string, title string, piece int, text string"), [], "Section")
    assert [r["text"] for r in headed.orderBy("section", "piece").collect()] == ["a", "Section 4A. Tax (continued)\nb", "Section 5 (continued)\nc"]
