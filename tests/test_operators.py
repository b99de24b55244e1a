"""Operators on inline rows: the facts that define them, ties, nulls and empty inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.functions.numbers import calculate, numbers_in
from tessera.operators import chunking
from tessera.operators.aggregates import allocate, nearest_rank
from tessera.operators.lookup import companions, final_ranks
from tessera.operators.ordered import anchored_clusters, as_of, greedy_groups, last_within, monotone, number_chain
from tessera.operators.retrieval import bm25, dense_knn, fuse, means_with_total, ranking_metrics
from tessera.operators.serving import daily_quota, sliding_limit
from tessera.sources.tables import cached, last_by_key, read_glossary, upsert, write_snapshot


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"])
    return row.select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize(("day", "year"), [("2026-06-30", 2026), ("2026-07-01", 2027), ("2025-12-31", 2026), ("2026-01-01", 2026)])
def test_tax_year(spark, day, year):
    assert one(spark, t.tax_year_of(F.to_date(F.lit(day)))) == year


def test_tax_year_in_force(spark):
    assert one(spark, t.tax_year_in_force(F.to_date(F.lit("2026-06-30")))) == 2027


@pytest.mark.parametrize(("text", "year"), [("for 2024-25", 2025), ("2000-50 or 2024-25", None), ("tax year 2026", 2026), ("ٹیکس سال ۲۰۲۶", 2026), ("bought in 2025", None), ("TY: 2024", 2024), (None, None)])
def test_tax_year_extract(spark, text, year):
    assert one(spark, t.tax_year(F.lit(text).cast("string"))) == year


def test_bm25_on_a_small_corpus(spark):
    docs = spark.createDataFrame([(1, "salary tax rates"), (2, "tax on income from rent of property property"), (3, "definitions of terms"), (4, ""), (5, None)], "doc_id int, text string")
    asks = spark.createDataFrame([(1, "tax on rent of property"), (2, "ٹیکس"), (3, "property property")], "q int, text string")
    got = bm25(docs, asks, "doc_id", "q", 3).collect()
    assert next(r["doc_id"] for r in got if r["q"] == 1 and r["rank"] == 1) == 2
    assert not [r for r in got if r["q"] == 2]
    idf = math.log(1 + (5 - 1 + 0.5) / 1.5)
    size, mean = 6, 11 / 5  # "on" and "of" are stop words
    score = idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * (size - 1 + 0) / mean))
    assert next(r["score"] for r in got if r["q"] == 3) == pytest.approx(2 * score, rel=0.2)


def test_fusion_scores_and_ties(spark):
    lists = [spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(x)], "q int, doc string, rank int") for x in (["a", "b", "c"], ["b", "a", "d"])]
    got = {r["doc"]: (r["score"], r["rank"]) for r in fuse(lists, "q", "doc", 10).collect()}
    assert got["a"] == (pytest.approx(1 / 61 + 1 / 62, abs=1e-9), 1) and got["b"][1] == 2 and [d for d, _ in sorted(got.items(), key=lambda x: x[1][1])] == ["a", "b", "c", "d"]


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(1, "s2", 1), (1, "s2", 2), (1, "s149", 3), (1, "s155", 4)], "q int, doc string, rank int")
    gold = spark.createDataFrame([(1, "s149"), (1, "s236K"), (2, "s1")], "q int, doc string")
    got = {r["q"]: r for r in ranking_metrics(ranked, gold, "q", "doc").collect()}
    assert (got[1]["hit"], got[1]["recall"], got[1]["rr"]) == (1.0, 0.5, 0.5)
    assert (got[2]["hit"], got[2]["recall"], got[2]["rr"]) == (0.0, 0.0, 0.0)


def test_means_with_total_keeps_null_groups_apart(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "g string, v double")
    got = {r["g"]: (r["v"], r["n"]) for r in means_with_total(rows, "g", ["v"]).collect()}
    assert got == {"a": (2.0, 2), None: (5.0, 1), "all": (3.0, 3)}


def test_dense_search_in_blocks(spark):
    v = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(50)] + [(99, [0.0, 0.0])], "id long, e array<double>")
    got = dense_knn(v, v.filter("id % 7 = 0"), "id", "e", 3, query_block=3, vector_block=8).collect()
    for q in range(0, 50, 7):
        want = sorted((i for i in range(50) if i != q), key=lambda i: (-round(math.cos(i - q), 6), i))[:3]
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_monotone_headings(spark):
    rows = spark.createDataFrame([(1, 1, "2"), (1, 2, "10"), (1, 3, "9"), (1, 4, "10A"), (1, 5, "10A")], "law int, ord int, number string")
    assert [r["accepted"] for r in monotone(rows, ["law"], ["ord"], t.section_key(F.col("number"))).orderBy("ord").collect()] == [True, True, False, True, False]


def test_folds(spark):
    row = spark.createDataFrame([([400, 400, 100, 800, 10], [1.0, 3.5, 4.1, 7.0, 7.2], [3, 1, 1, 2, 5, 3])], "s array<int>, x array<double>, n array<int>")
    r = row.select(greedy_groups(F.col("s"), 770).alias("s"), anchored_clusters(F.col("x"), 3.0).alias("x"), number_chain(F.col("n")).alias("n")).first()
    assert r["s"] == [0, 1, 1, 2, 3] and r["x"] == [1.0, 4.1, 7.2] and r["n"] == [1, 2, 3]


def test_as_of_takes_the_row_at_the_same_time(spark):
    left = spark.createDataFrame([("a", 5, "x"), ("a", 1, "y"), ("b", 9, "z")], "k string, at int, v string")
    right = spark.createDataFrame([("a", 5, 50), ("a", 2, 20)], "k string, at int, w int")
    assert {r["v"]: r["last"] for r in as_of(left, right, ["k"], "at", "w", "last").collect()} == {"x": 50, "y": None, "z": None}


def test_limits(spark):
    log = spark.createDataFrame([(u, i, f"2026-01-01 00:{m:02d}:00") for u in ("a", "b") for i, m in enumerate((0, 1, 2, 30, 59))], "u string, i int, s string").select("u", "i", F.to_timestamp("s").alias("ts"))
    got = sliding_limit(log, "u", "ts", "i", 2, 1800).collect()
    assert all([r["allowed"] for r in sorted((r for r in got if r["u"] == u), key=lambda r: r["i"])] == [True, True, False, False, True] for u in "ab")
    assert daily_quota(log, "u", "ts", "i", 2).count() == 4 and daily_quota(log, "u", "ts", "i", 0).count() == 10


def test_allocation_never_reduces(spark):
    groups = spark.createDataFrame([("big", 1000), ("s1", 1), ("s2", 1), ("s3", 1)], "g string, n long")
    got = {r["g"]: r["share"] for r in allocate(groups, "g", "n", 3).collect()}
    assert got == {"big": 2, "s1": 1, "s2": 1, "s3": 1}


def test_nearest_rank_rounds_to_even(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in range(1, 7)], "g string, v double")
    assert nearest_rank(rows, "g", "v", {"p50": 0.5}).first()["p50"] == 3.0  # place 2.5 is rounded to 2


def test_nearest_rank_cuts_buckets_once(spark, monkeypatch):
    import random

    # quantiles that come out differently each time they are made, as they do where executors' parts arrive in another order
    anew = F.udf(lambda most: sorted(random.SystemRandom().uniform(0, most) for _ in range(5)), "array<double>").asNondeterministic()
    monkeypatch.setattr(F, "percentile_approx", lambda value, at, accuracy: anew(F.max(value)))
    rows = spark.createDataFrame([("a", float(v)) for v in range(1, 2002)] + [("b", float(v)) for v in range(1, 1002)], "g string, v double")
    got = {r["g"]: (r["p50"], r["p95"]) for r in nearest_rank(rows, "g", "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got == {"a": (1001.0, 1901.0), "b": (501.0, 951.0)}


def test_final_ranks_have_a_floor(spark):
    c = spark.createDataFrame([(1, "a", "search", 1), (1, "b", "lookup", 2), (1, "c", "search", 3)], "question_id int, chunk_id string, via string, prior int")
    p = spark.createDataFrame([(1, "a", -3.0), (1, "c", 0.5)], "question_id int, chunk_id string, score double")
    assert [(r["chunk_id"], r["score"]) for r in final_ranks(c, p).orderBy("rank").collect()] == [("b", 0.0), ("c", 0.5), ("a", 0.0)]


@pytest.mark.parametrize(("text", "found"), [("ten million rupees", {10.0, 1e7}), ("Rs. 2 crore", {2.0, 2e7}), ("[fifty]million", {50.0, 5e7}), ("first", {1.0}), ("one hundred and eighty-three", {183.0}), ("", set()), (None, set())])
def test_numbers(text, found):
    assert numbers_in(text) == found


def test_arithmetic_runs_no_code():
    assert calculate("5% x 200,000") == 10000 and calculate("exit()") is None and calculate("2 ** 9999999") is None


LAW = [
    ("1. Short title.—(1) This Act is called the Act.", True, 1), ("(2) It extends to the whole coun-", False, 1), ("try of the land.", False, 1), ("2. Definitions.— In this Act,", True, 2),
    ("(1) words", False, 2), ("1. a heading that goes down", True, 2), ("(2) " + "long words " * 30, False, 3), ("(3) " + "more words " * 30, False, 3), ("[ ]", False, 3),
]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([("L", i, text, bold, page) for i, (text, bold, page) in enumerate(LAW)], "law string, ord int, text string, bold boolean, page int")


def test_chunks(lines):
    got = {r["chunk_id"]: r for r in chunking.chunk(lines, max_tokens=150).collect()}
    assert list(sorted(got)) == ["L-s1", "L-s2-1", "L-s2-2"]
    assert got["L-s1"]["title"] == "Short title" and "whole coun-try of the land" in got["L-s1"]["text"]
    assert got["L-s2-1"]["title"] == "Definitions" and "goes down" in got["L-s2-1"]["text"] and got["L-s2-1"]["label"] == "(1)-(2)" and got["L-s2-2"]["label"] == "(3)"
    assert (got["L-s2-1"]["page"], got["L-s2-1"]["page_end"]) == (2, 3)
    assert all(r["n_tokens"] <= 150 for r in got.values())


def test_coverage(lines, spark):
    toc = spark.createDataFrame([("L", "1", "Short title"), ("L", "3", "Missing"), ("L", "4", "Omitted")], "law string, section string, title string")
    assert {tuple(r) for r in chunking.coverage(chunking.chunk(lines), toc).collect()} == {("L", "3", "no chunk"), ("L", "2", "not listed")}


def test_chunking_reads_lines_once(spark):
    lines = spark.createDataFrame([("L", 1, "1. Title.—(1) Text", True, 1)], "law string, ord long, text string, bold boolean, page int")
    toc = spark.createDataFrame([("L", "1", "Title")], "law string, section string, title string")
    for result, most in ((chunking.chunk(lines), 0), (chunking.coverage(chunking.chunk(lines), toc), 2)):  # the contents are read for each of two ways
        assert result._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= most


def test_pairs_of_items_are_found_once(spark):
    from tessera.plans.question_queries import _asked

    assert "MapInArrow" not in _asked(spark, "/root/testdata/sf0.001")[1]._jdf.queryExecution().optimizedPlan().toString()


def test_sources(spark, tmp_path):
    (tmp_path / "g.csv").write_text('roman,urdu,english,section_ids,search,notes\n"Filer | active filer",فائلر,filer,L-s1  L-s2,Yes,\n,,none,,,\n', encoding="utf-8")
    a, b = read_glossary(spark, f"file://{tmp_path}/g.csv").collect()
    assert a["roman"] == ["filer", "active filer"] and a["section_ids"] == ["L-s1", "L-s2"] and a["search"] and not b["search"] and b["roman"] == []
    log = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 3, "x")], "key string, line int, output string")
    cache = last_by_key(log, "key", "line").drop("line")
    assert {tuple(r) for r in cache.collect()} == {("k", "new"), ("j", "x")}
    known, todo = cached(spark.createDataFrame([("k",), ("z",)], "key string"), cache, "key")
    assert {(r["key"], r["output"]) for r in known.collect()} == {("k", "new"), ("z", None)} and [r["key"] for r in todo.collect()] == ["z"]
    assert {tuple(r) for r in upsert(cache, spark.createDataFrame([("k", "newer")], "key string, output string"), ["key"]).collect()} == {("k", "newer"), ("j", "x")}
    chunks = spark.createDataFrame([("ITO", "2026-06-30", "c1"), ("ITR", "2025-06-30", "c2")], "law string, version_date string, chunk_id string")
    write_snapshot(chunks, f"file://{tmp_path}/chunks")
    plan = spark.read.parquet(f"file://{tmp_path}/chunks").filter("law = 'ITO'")
    assert [r["chunk_id"] for r in plan.collect()] == ["c1"] and "PartitionFilters: [isnotnull(law" in plan._jdf.queryExecution().toString()


def test_ask(spark):
    from tessera.plans.answering import ask

    chunks = spark.createDataFrame([("c1", "L-s1", "salary income is taxed monthly by employers", 2020, 2026), ("c2", "L-s1", "salary income is taxed yearly by employers", 2027, None), ("c3", "L-s2", "property rent income withholding", 2020, None)], "chunk_id string, section_id string, text string, tax_year_from int, tax_year_to int")
    sections = spark.createDataFrame([("section", "1", "L-s1"), ("section", "2", "L-s2")], "kind string, number string, section_id string")
    questions = spark.createDataFrame([(1, "salary income of employers"), (2, "salary income employers tax year 2025"), (3, "section 2 salary"), (4, "section 9 zebra"), (5, "zebra quagga"), (6, "salary tax year 2001")], "question_id int, text string")
    decisions, sources = ask(questions, chunks, sections, 2027, 2003, 2027)
    reason = {r["question_id"]: r["reason"] for r in decisions.collect()}
    assert reason == {1: None, 2: None, 3: None, 4: "SECTION_NOT_FOUND", 5: "NO_RELEVANT_SOURCES", 6: "TAX_YEAR_NOT_COVERED"}
    first = {r["question_id"]: r["chunk_id"] for r in sources.filter("rank = 1").collect()}
    assert first[1] == "c2" and first[2] == "c1" and first[3] == "c3"


def test_ask_ranks_only_the_year(spark):
    from tessera.plans.answering import ask

    old = [(f"a{i:02d}", "L-s1", "salary income of employers", 2010, 2020) for i in range(40)]
    chunks = spark.createDataFrame([*old, ("z1", "L-s1", "salary income is taxed monthly by employers, says this section", 2021, None)], "chunk_id string, section_id string, text string, tax_year_from int, tax_year_to int")
    sections = spark.createDataFrame([("section", "1", "L-s1")], "kind string, number string, section_id string")
    questions = spark.createDataFrame([(1, "salary income of employers"), (2, "salary income of employers tax year 2015")], "question_id int, text string")
    decisions, sources = ask(questions, chunks, sections, 2027, 2003, 2027)
    assert {r["question_id"]: r["reason"] for r in decisions.collect()} == {1: None, 2: None}
    found = {(r["question_id"], r["chunk_id"]) for r in sources.collect()}
    assert {c for q, c in found if q == 1} == {"z1"} and len({c for q, c in found if q == 2}) == 6 and (2, "z1") not in found


def test_windows_are_chosen_for_each_question(spark):
    from tessera.operators.lookup import fitted_pairs, shared_words

    text = " ".join(["filler"] * 500 + ["zebra"] + ["filler"] * 500 + ["quagga"] + ["filler"] * 300)
    docs = spark.createDataFrame([(1, text), (2, "zebra quagga")], "doc_id int, text string")
    pairs = spark.createDataFrame([(7, 1), (8, 1), (8, 2)], "item_id int, doc_id int")
    asked = spark.createDataFrame([(7, "zebra"), (8, "quagga"), (9, "filler")], "item_id int, w string")
    found = {(r["item_id"], r["doc_id"], r["w"]) for r in shared_words(docs, "doc_id", "text", pairs, asked, "item_id", 800).collect()}
    assert found == {(7, 1, "zebra"), (8, 1, "quagga")}
    fit = {(r["item_id"], r["doc_id"]): r["text"] for r in fitted_pairs(docs, "doc_id", "text", pairs, asked, "item_id", 2500).collect()}
    assert "zebra" in fit[7, 1] and "quagga" not in fit[7, 1] and "quagga" in fit[8, 1] and "zebra" not in fit[8, 1] and fit[8, 2] == "zebra quagga"


def test_windows_cover_every_item(spark):
    from tessera.plans.registry import QUERIES

    items = {r["item_id"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()}
    assert {r["item_id"] for r in QUERIES["fit_sources_per_item"](spark, "/root/testdata/sf0.001").collect()} == items


def test_json_lines(spark, tmp_path):
    from tessera import schemas
    from tessera.sources.tables import checked, read_json_lines, read_pages

    (tmp_path / "pages.jsonl").write_text('{"page": 1, "lines": [{"page": 1, "y": 2.0, "text": "a", "fn_refs": ["1"]}], "footnotes": [{"page": 1, "marker": "1", "text": "note"}]}\n\n{"page": 2, "lines": [], "footnotes": []}\n')
    lines, notes = read_pages(spark, f"file://{tmp_path}/pages.jsonl")
    assert [(r["text"], r["fn_refs"]) for r in lines.collect()] == [("a", ["1"])] and [r["marker"] for r in notes.collect()] == ["1"]
    (tmp_path / "votes.jsonl").write_text('{"ask_id": "a", "rating": "up"}\n{"ask_id": "b", "rating": "sideways"}\n')
    votes = read_json_lines(spark, f"file://{tmp_path}/votes.jsonl", schemas.FEEDBACK)
    assert votes.count() == 2
    with pytest.raises(Exception, match="rating: sideways"):
        checked(votes, {"rating": schemas.ALLOWED["rating"]}).collect()
    (tmp_path / "bad.jsonl").write_text('{"ask_id": "a", "id": "no number"}\n')
    with pytest.raises(Exception):
        read_json_lines(spark, f"file://{tmp_path}/bad.jsonl", schemas.FEEDBACK).collect()


class _Cluster:
    """A session on a cluster, as far as the shared folder asks."""

    class sparkContext:
        master, applicationId = "spark://host:7077", "app"

    class conf:
        settings: dict = {}

        @classmethod
        def get(cls, key, default=None):
            return cls.settings.get(key, default)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from tessera.sources.shared import shared_folder

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(_Cluster, "x")
    monkeypatch.setitem(_Cluster.conf.settings, "spark.checkpoint.dir", "hdfs://shared/dir/")
    assert shared_folder(_Cluster, "x").startswith("hdfs://shared/dir/tessera/x-")


def test_sweep(spark):
    import os

    from tessera.sources.shared import sweep, written

    rows = written(spark.range(3), "swept")
    path = rows.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and sweep(spark) >= 1 and not os.path.exists(path) and sweep(spark) == 0


def test_companions_of_one_place_go_by_chunk(spark):
    parts = spark.createDataFrame([(q, 0, 1, c) for q in range(20) for c in ("d", "b", "c", "a")], "question_id int, priority int, ord int, chunk_id string").repartition(7)
    got = companions(parts, spark.createDataFrame([(0, "a")], "question_id int, chunk_id string")).collect()
    assert sorted((r["question_id"], r["rank"], r["chunk_id"]) for r in got) == [(q, i + 1, c) for q in range(20) for i, c in enumerate("bcd" if q == 0 else "abc")]


def test_last_within_makes_no_pairs(spark):
    r = random.Random(3)
    points = [(g, i, r.randrange(-300, 300) / 4) for i in range(60) for g in (1, 2)] + [(1, 99, None), (None, 98, 5.0)]
    values = [(r.choice([1, 2]), r.randrange(-400, 400) / 4) for _ in range(60)] + [(None, 5.0), (1, None)]
    found = last_within(spark.createDataFrame(points, "g int, i int, h double"), spark.createDataFrame(values, "g int, x double"), ["g"], "h", "x", 4.0, 0.5)
    near = {(g, i): max((x for k, x in values if k == g and g is not None and x is not None and h is not None and h - 4.0 <= x <= h + 0.5), default=None) for g, i, h in points}
    assert {(x["g"], x["i"]): x["x"] for x in found.collect()} == near
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
