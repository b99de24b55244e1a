"""Set-ups, graded metrics, excerpts, inherited verdicts and cards by hand."""

from pyspark.sql import functions as F

from tessera.operators import evaluation, sizes
from tessera.operators.cards import card_companions, card_index, rule_starts
from tessera.operators.evaluation import gold_excerpts, graded_metrics, inherited_verdicts, run_setups, shared_counts, summary_by_group
from tessera.sources.shared import written


def test_setups_share_lists(spark):
    setups = spark.createDataFrame([("words", ["bm25"], 2, None), ("both", ["dense", "bm25"], 3, None), ("reranked", ["dense", "bm25"], 3, "q"), ("none", ["absent"], 3, "q")], "setup string, lists array<string>, candidates int, rerank string")
    lists = spark.createDataFrame([("bm25", 1, d, i + 1) for i, d in enumerate("abc")] + [("dense", 1, d, i + 1) for i, d in enumerate("bad")], "list string, q int, doc string, rank int")
    scores = spark.createDataFrame([("q", 1, "d", 0.9), ("q", 1, "a", 0.2), ("other", 1, "b", 1.0)], "kind string, q int, doc string, score double")
    got = {}
    for r in run_setups(setups, lists, scores, "q", "doc").collect():
        got.setdefault(r["setup"], {})[r["rank"]] = r["doc"]
    # a and b share both ranks; the earlier list decides, then d (rank 3 of the first list) goes before c
    assert got == {"words": {1: "a", 2: "b"}, "both": {1: "b", 2: "a", 3: "d"}, "reranked": {1: "d", 2: "a", 3: "b"}}


def test_graded_metrics(spark):
    ranked = spark.createDataFrame([("s", 1, "x", 1), ("s", 1, "acc", 2), ("s", 1, "g1", 6), ("s", 2, "g2", 5), ("s", 3, "y", 1)], "setup string, q int, doc string, rank int")
    relevant = spark.createDataFrame([(1, "acc", False), (1, "g1", True), (1, "g1", True), (1, "g9", True), (2, "g2", True), (3, "g3", True), (4, "only", False)], "q int, doc string, gold boolean")
    rows = graded_metrics(ranked, relevant, ["setup"], "q", "doc").collect()
    assert {r["q"]: (r["hit"], r["recall"], r["rr"]) for r in rows} == {1: (1.0, 0.0, 0.5), 2: (1.0, 1.0, 0.2), 3: (0.0, 0.0, 0.0)}
    groups = spark.createDataFrame(rows).withColumn("g", F.when(F.col("q") == 1, "one").otherwise("rest"))
    assert {(r["g"], r["n"], r["hit"]) for r in summary_by_group(groups, ["setup"], "g", ["hit"]).collect()} == {("one", 1, 1.0), ("rest", 2, 0.5), ("all", 3, 0.6667)}


def test_excerpts(spark):
    items = spark.createDataFrame([("i", "private company pays income", ["s1", "s2"]), ("all", "x", ["s2"]), ("none", "x", ["s9"])], "item string, text string, gold array<string>")
    chunks = spark.createDataFrame([
        ("s1", 1, "c1", "nothing of it", 40), ("s1", 2, "c2", "a private company pays", 50), ("s1", 3, "c3", "company private income pays", 30), ("s2", 1, "d1", "huge chunk of the second section", 90), ("s2", 2, "d2", "", 5),
    ], "section_id string, ord int, chunk_id string, text string, n_tokens int")
    got = {}
    for r in gold_excerpts(items, chunks, "item", 160).collect():
        got.setdefault(r["item"], {})[r["place"]] = r["chunk_id"]
    # c2 (pairs) and d1 are the best of their sections; c3 no longer fits, d2 does
    assert got == {"i": {1: "c2", 2: "d1", 3: "d2"}, "all": {1: "d1", 2: "d2"}}


def test_verdicts_pass_along_chains(spark):
    items = spark.createDataFrame([("a", None, None), ("b", "a", True), ("c", "b", False), ("d", "c", True), ("x", "gone", True), ("y", "x", True), ("p", "q", True), ("q", "p", True), ("r", "q", False), ("n", None, True), ("z", "z", True)], "id string, source_id string, language_ok boolean")
    verdicts = spark.createDataFrame([("a", True, [], "disagree")], "id string, ok boolean, reasons array<string>, second_opinion string")
    got = {r["id"]: (r["ok"], r["reasons"], r["second_opinion"]) for r in inherited_verdicts(items, verdicts).collect()}
    circle, unworded = "source questions go in a circle", "translation wording not checked by a native speaker yet"
    assert got == {
        "a": (True, [], "disagree"), "b": (True, [], "disagree"), "c": (False, [unworded], "disagree"), "d": (False, ["source question c is flagged"], "disagree"), "x": (False, ["source question gone not verified"], None), "y": (False, ["source question x is flagged"], None),
        "p": (False, [circle], None), "q": (False, [circle], None), "r": (False, [circle, unworded], None), "n": (False, ["not verified"], None), "z": (False, [circle], None),
    }


def test_long_chains(spark):
    rows = [(f"i{k}", f"i{k - 1}" if k else None, True) for k in range(200)]
    got = inherited_verdicts(spark.createDataFrame(rows, "id string, source_id string, language_ok boolean"), spark.createDataFrame([("i0", True, [], "agree")], "id string, ok boolean, reasons array<string>, second_opinion string"))
    assert got.filter("ok AND second_opinion = 'agree'").count() == 200


def test_circles_take_no_more_rounds(spark, monkeypatch):
    made = []
    monkeypatch.setattr(evaluation, "written", lambda df, label: made.append(label) or written(df, label))
    rows = [("p", "q", True), ("q", "p", True), ("r", "q", True), ("x", "gone", True), ("y", "x", True)] + [(f"i{k}", f"i{k - 1}" if k % 4 else None, True) for k in range(1000)]
    verdicts = spark.createDataFrame([(f"i{k}", True, [], "agree") for k in range(0, 1000, 4)], "id string, ok boolean, reasons array<string>, second_opinion string")
    got = inherited_verdicts(spark.createDataFrame(rows, "id string, source_id string, language_ok boolean"), verdicts)
    assert len(made) == 4  # the start, chains of one, of up to three, and a round that ends none
    assert got.filter("ok AND second_opinion = 'agree'").count() == 1000
    assert {r["id"] for r in got.filter("NOT ok").collect()} == {"p", "q", "r", "x", "y"}


def test_many_items_are_not_sent_to_the_driver(spark, monkeypatch):
    items = spark.createDataFrame([("a", None, True), ("b", "a", True)], "id string, source_id string, language_ok boolean")
    verdicts = spark.createDataFrame([("a", True, [], "agree")], "id string, ok boolean, reasons array<string>, second_opinion string")
    monkeypatch.setattr(sizes, "few", lambda df, most_rows=0: False)
    plan = inherited_verdicts(items, verdicts)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


CARD = "chunk_id string, section_id string, law_code string, section string, schedule string, ord int, text string"


def test_cards(spark):
    chunks = spark.createDataFrame([
        ("O-sch10-1", "O-sch10", "ITO", None, "Tenth", 1, "1. Rate of tax. 3. Not yet (2) nor this. 2. [The next"), ("O-sch10-2", "O-sch10", "ITO", None, "Tenth", 2, "3. Third 10. Tenth"), ("O-sch10-t1", "O-sch10", "ITO", None, "Tenth", 3, "1. Table"),
        ("card-149", "W1", "WHT", "149", None, 4, "R. 3 of the Tenth Schedule"), ("card-236K", "W2", "WHT", "236K", None, 5, "Division-X, Part-IV of the First Schedule, R.1 of Tenth Schedule"), ("card-236K-2", "W2", "WHT", "236K", None, 6, "R.2 of Tenth Schedule"),
        ("O-s149", "O-s149", "ITO", "149", None, 7, ""), ("O-sch1-pIV-divX-t1", "O-sch1", "ITO", None, "First", 8, ""), ("O-s7", "O-s7", "ITO", "7", None, 9, ""),
    ], CARD)
    index = card_index(chunks, "O-sch10", "ITO", "O-sch1")
    assert {tuple(r) for r in index.rules.collect()} == {(1, "O-sch10-1"), (2, "O-sch10-1"), (3, "O-sch10-2")}
    assert {tuple(r) for r in index.divisions.collect()} == {("O-sch1-pIV-divX", "236K")}
    top = spark.createDataFrame([(1, "O-sch1-pIV-divX-t1", 1), (2, "O-s149", 1), (3, "O-s149", 1), (4, "card-149", 2), (4, "O-sch10-2", 1), (5, "O-s7", 1), (6, "O-s7", 1), (7, "O-s7", 1), (7, "O-s7", 1)], "question_id int, chunk_id string, rank int").distinct()
    asks = spark.createDataFrame([(1, False, []), (2, False, []), (3, True, ["O-s236K"]), (4, True, []), (5, True, ["Z-s236K", "O-s236K"]), (6, False, ["O-s236K"]), (7, None, None)], "question_id int, filer boolean, named array<string>")
    got = {}
    for r in card_companions(index, top, chunks, asks, "O").collect():
        got.setdefault(r["question_id"], {})[r["rank"]] = r["chunk_id"]
    assert got == {1: {1: "card-236K", 2: "O-sch10-1", 3: "O-sch10-t1"}, 3: {1: "card-149", 2: "O-sch10-1", 3: "O-sch10-2"}, 4: {1: "O-sch10-1"}, 5: {1: "card-236K", 2: "O-sch10-1", 3: "O-sch10-t1"}}
    assert rule_starts(chunks.limit(0).withColumn("ord", F.col("ord").cast("long"))).collect() == []


def test_pieces_that_share_a_chunk_id_are_one_source(spark):
    rows = [("card-1", "W1", "WHT", "149", None, 0, "Division-X of Part-IV of the First Schedule")] + [("O-sch1-pIV-divX", "O-sch1", "ITO", None, "First", i, "") for i in range(1, 50)]
    index = card_index(spark.createDataFrame(rows, CARD), "O-sch10", "ITO", "O-sch1")
    assert [tuple(r) for r in index.sections.select("chunk_id", "section").collect()] == [("O-sch1-pIV-divX", "149")]


def test_excerpts_count_shared_words_once(spark):
    items = spark.createDataFrame([(1, "rates of tax", [1])], "item long, text string, gold array<long>")
    chunks = spark.createDataFrame([(1, 1, "c", "the rates of tax of rates", 5)], "section_id long, ord long, chunk_id string, text string, n_tokens long")
    counts = chunks.select(shared_counts(F.array(F.lit("rates of"), F.lit("tax rates")), F.array(F.lit("rates"), F.lit("rate")), "text").alias("s")).first()["s"]
    assert tuple(counts) == (1, 1)
    assert "array_intersect" not in gold_excerpts(items, chunks, "item", 1)._jdf.queryExecution().optimizedPlan().toString()
