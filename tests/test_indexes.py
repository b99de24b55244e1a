"""Inverted file, term automaton, stored statistics and the snapshot table against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import block_scores, retrieval, term_match, vector_index
from tessera.operators.index_stats import change_of, changed_rows, merged, statistics
from tessera.operators.ordered import numbered
from tessera.operators.retrieval import bm25
from tessera.operators.term_match import terms_in
from tessera.operators.vector_index import choose_probes, filtered_knn, fit_centroids, index_vectors, recall_of
from tessera.sources.shared import shared_folder
from tessera.sources.snapshots import Conflict, Files, SnapshotTable, UnknownIds, commit, latest

# --- inverted file


def clustered(n=400, d=8, seed=1):
    r = np.random.default_rng(seed)
    centers = r.standard_normal((10, d)) * 4
    return [(i, (centers[0 if i < n // 3 else i % 10] + r.standard_normal(d)).tolist(), 2000 + i % 6, None if i % 4 else 2003 + i % 3, f"L{i % 3}") for i in range(n)]


def exact(rows, qid, year, laws, k):
    m = {r[0]: np.array(r[1], np.float32).astype(float) for r in rows if r[1]}
    q = m[qid]
    left = [r for r in rows if r[1] and r[0] != qid and (year is None or r[2] <= year and (r[3] is None or year <= r[3])) and (laws is None or r[4] in laws)]
    score = {r[0]: round(float(m[r[0]] @ q / (np.linalg.norm(m[r[0]]) * np.linalg.norm(q))), 6) for r in left}
    return sorted(score, key=lambda i: (-score[i], i))[:k]


@pytest.fixture
def vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "LIST_BLOCK", 25)  # a list is several blocks
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 3)
    rows = clustered() + [(1000, None, 2000, None, "L0")]
    df = spark.createDataFrame(rows, "vec_id long, v array<float>, valid_from int, valid_to int, law string").repartition(3)
    centroids = fit_centroids(df, "vec_id", "v", 12)
    return rows, df, centroids, index_vectors(df, "vec_id", "v", centroids, [F.col("valid_from"), F.col("valid_to"), F.col("law")])


ASKED = [(0, None, None), (7, 2002, None), (50, None, ["L1"]), (133, 2004, ["L0", "L2"]), (200, 1990, None), (399, 2001, ["nothing"]), (301, 2000, ["L1"])]


def test_filtered_neighbours(spark, vectors):
    rows, df, centroids, index = vectors
    assert index.count() == 400 and len(centroids) == 12
    by_id = {r[0]: r for r in rows}
    queries = spark.createDataFrame([(i, by_id[i][1], y, laws) for i, y, laws in ASKED], "id long, v array<float>, year int, laws array<string>")

    def found(probes):
        got = {}
        for r in filtered_knn(index, queries, centroids, 5, probes).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
        return {q: [g[i] for i in sorted(g)] for q, g in got.items()}

    want = {i: w for i, y, laws in ASKED if (w := exact(rows, i, y, laws, 5))}
    assert found(None) == want
    few = found(2)
    assert {q: len(x) for q, x in few.items()} == {q: len(x) for q, x in want.items()}  # a narrow filter shortens no result
    probes = choose_probes(index, queries, centroids, 5, 1.0)
    assert recall_of(filtered_knn(index, queries, centroids, 5, probes), filtered_knn(index, queries, centroids, 5)).first()["recall"] == 1.0
    assert 1 <= choose_probes(index, queries, centroids, 5, 0.5) <= probes <= 12


def test_empty_index(spark):
    none = spark.createDataFrame([], "vec_id long, v array<float>, valid_from int, valid_to int, law string")
    assert fit_centroids(none, "vec_id", "v", 4).shape == (0, 0)
    queries = spark.createDataFrame([(1, [1.0], None, None)], "id long, v array<float>, year int, laws array<string>")
    centroids = fit_centroids(none, "vec_id", "v", 4)
    assert filtered_knn(index_vectors(none, "vec_id", "v", centroids, [F.col("valid_from"), F.col("valid_to"), F.col("law")]) if len(centroids) else none, queries, centroids, 3).collect() == []


# --- terms

TERMS = [
    (1, ["tankhwah", "salary"], ["تنخواہ"]), (2, ["filer"], ["فائلر"]), (3, ["non filer", "non-filer"], []), (4, ["kab"], ["کب"]), (5, ["income tax", "tax"], None), (6, ["a.b"], []), (7, None, ["ٹیکس"]), (8, ["", "tax"], []), (9, ["filers", "filer"], []),
]
TEXTS = [
    (1, "Salary of a NON-FILER"), (2, "salaries salaryman salarymen salarymenx"), (3, "kab kabhi"), (4, "taxes; income taxes"), (5, "a.b a.bc axb"), (6, "تنخواہ پر ٹیکس کب"), (7, "غیرتنخواہ"), (8, None), (9, ""), (10, "prefiler filer2 filers"),
    (11, "İ filer" + " x" * 40_000), (12, "éfiler filerés"),
]


def by_patterns(text, terms):
    """One regular expression a term, as a plain version."""
    low, found = (text or "").lower(), []
    for ord_, roman, urdu in terms:
        parts = [re.escape(s) + ("[a-z]{0,3}" if len(s) >= 5 and "a" <= s[-1] <= "z" else "") for s in roman or [] if s]
        m = re.search(f"(?:^|[^a-z])({'|'.join(parts)})(?:[^a-z]|$)", low) if parts else None
        term = m[1] if m else next((u for u in urdu or [] if re.search(f"(?:^|[^؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿]){re.escape(u)}", low)), None)
        if term:
            found.append((ord_, term))
    return sorted(found, key=lambda x: (-len(x[1]), x[0]))


@pytest.mark.parametrize("spellings", [200_000, 3])
def test_terms(spark, monkeypatch, spellings):
    monkeypatch.setattr(term_match, "SPELLINGS", spellings)
    r = random.Random(4)
    texts = TEXTS + [(100 + i, " ".join(r.choice(["salary", "filer", "non", "taxes", "kab", "filersx", "a.b", "income", "تنخواہ"]) for _ in range(6))) for i in range(60)]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    terms = spark.createDataFrame(TERMS, "ord long, roman array<string>, urdu array<string>")
    got = {}
    for x in terms_in(df, "id", terms, 4).collect():
        got.setdefault(x["id"], []).append((x["rank"], x["ord"], x["term"]))
    assert {i: [x[1:] for x in sorted(g)] for i, g in got.items()} == {i: w[:4] for i, t in texts if (w := by_patterns(t, TERMS))}
    assert terms_in(df, "id", terms.limit(0), 4).collect() == []


def test_terms_are_no_nested_loop(spark):
    texts, terms = spark.createDataFrame(TEXTS, "id long, text string"), spark.createDataFrame(TERMS, "ord long, roman array<string>, urdu array<string>")
    plan = terms_in(texts, "id", terms, 4)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_many_phrases_are_read_once(spark, monkeypatch):
    monkeypatch.setattr(term_match, "SPELLINGS", 3)
    r = random.Random(6)
    terms = [(i, [f"{a} {b}"], None) for i, (a, b) in enumerate((a, b) for a in ("tax", "rate", "of") for b in ("due", "paid", "sal", "o"))] + [(50, ["ta", "tax due now"], None), (51, ["filer", "a.b"], None), (52, None, ["ٹیکس"])]
    texts = [(i, " ".join(r.choice(["tax", "rate", "of", "duex", "due", "paids", "salary", "o", "now", "filers", "a.b", "Tax", "tax,", "ٹیکس"]) for _ in range(9))) for i in range(80)] + [(900, None), (901, "")]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    joined, passes, phrases, search = [], [], term_match._phrases, term_match._search
    monkeypatch.setattr(term_match, "_phrases", lambda *a: joined.append(a) or phrases(*a))
    monkeypatch.setattr(term_match, "_search", lambda *a: passes.append(a) or search(*a))
    found = terms_in(df, "id", spark.createDataFrame(terms, "ord long, roman array<string>, urdu array<string>"), 5)
    got = {}
    for x in found.collect():
        got.setdefault(x["id"], []).append((x["rank"], x["ord"], x["term"]))
    assert {i: [x[1:] for x in sorted(g)] for i, g in got.items()} == {i: w[:5] for i, t in texts if (w := by_patterns(t, terms))}
    assert len(joined) == 1 and len(passes) == 1  # one join of the plain phrases, one automaton of the three others


@pytest.mark.parametrize("decoys", [False, True])
def test_texts_send_few_phrases(spark, monkeypatch, decoys):
    monkeypatch.setattr(term_match, "SPELLINGS", 3)
    r = random.Random(9)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randint(1, 9))) for _ in range(40)]
    terms = [(i, [f"{a} {b}"], None) for i, (a, b) in enumerate((a, b) for a in words[:30] for b in words[:30])] + [(5000, [words[0], f"{words[1]} {words[2]}"], None), (5001, [words[3], f"{words[4]} {words[5]}"], None)]
    texts = [(i, " ".join(r.choice(words[:32]) + r.choice(["", "", "s"]) for _ in range(120))) for i in range(30)] + [(None, f"{words[0]} {words[1]}"), (901, "")]
    texts += [(i, " ".join(r.choice(words[:12]) for _ in range(120))) for i in range(5)]  # keys that repeat
    texts += [(200 + i, " ".join(f"{words[30]}{c}xxxxxxxx {words[31]}{c}yyyyyyyy {words[i]} {words[i + 1]}" for c in "hijklmnopqrstuv")) for i in range(10)]
    sent, rounds, phrases, marked = spark.sparkContext.accumulator(0), [], term_match._phrases, term_match._marked

    def counted(*a):
        run = phrases(*a)
        rounds.append(a)

        def inner(batches):
            for b in run(batches):
                sent.add(b.num_rows)
                yield b

        return inner

    monkeypatch.setattr(term_match, "_phrases", counted)
    if decoys:  # long phrases that are taken for spellings, so that texts have to be looked through again
        more = spark.createDataFrame([(f"{words[30]}{c}xxxxxxxx {words[31]}{c}yyyyyyyy",) for c in "hijklmnopqrstuv"], "spelling string")
        monkeypatch.setattr(term_match, "_marked", lambda rows, n: marked(rows.select("spelling").unionByName(more.limit(0 if rows.first()["several"] else 15)), n))
    found = terms_in(spark.createDataFrame(texts, "id long, text string").repartition(3), "id", spark.createDataFrame(terms, "ord long, roman array<string>, urdu array<string>"), 5)
    got, want = {}, {}
    for x in found.collect():
        got.setdefault(x["id"], []).append((x["rank"], x["ord"], x["term"]))
    for key, text in texts:
        for ord_, roman, _ in terms:
            m = re.search(f"(?:^|[^a-z])({'|'.join(re.escape(x) + ('[a-z]{0,3}' if len(x) >= 5 else '') for x in roman)})(?:[^a-z]|$)", text)
            if m:
                want.setdefault(key, {})[ord_] = min(want.get(key, {}).get(ord_, (1 << 30, "")), (m.start(1), m[1]), key=lambda x: x[0])
    assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == {k: sorted(((o, t) for o, (_, t) in v.items()), key=lambda x: (-len(x[1]), x[0]))[:5] for k, v in want.items()}
    assert len(rounds) == 1 + decoys
    assert decoys or sent.value < 2000  # 2899 where each phrase is sent


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"), F.lit("y").alias("n")).repartition(7)
    got = numbered(df, "x").collect()
    assert [r["x"] for r in sorted(got, key=lambda r: r["ord"])] == sorted(r["x"] for r in got) and sorted(r["ord"] for r in got) == list(range(1000))


# --- searches in blocks


def test_blocks_rank_as_joins_do(spark, monkeypatch):
    monkeypatch.setattr(block_scores, "TEXTS", 7)
    monkeypatch.setattr(block_scores, "PRODUCTS", 5)
    r = random.Random(8)
    words = ["tax", "rate", "salary", "rent", "éclair", "دفعہ", "filer", "the", "x1", "cap"]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randrange(12))), r.randrange(2000, 2004)) for i in range(120)] + [(500 + i, "tax rate", 2001) for i in range(30)] + [(900, None, 2000), (901, "", 2000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, since int").repartition(3)
    asks = spark.createDataFrame([((q, 0), " ".join(r.choice(words) for _ in range(5)), r.choice([1999, 2001, 2003, None])) for q in range(9)] + [((50, 1), "", 2001), ((51, 0), "nowhere", 2001)], "ask struct<q:int,n:int>, text string, year int")

    def ranked(blocks, where):
        monkeypatch.setattr(retrieval, "few", lambda *a: blocks)
        asked = retrieval.asked_terms(asks, "ask", ["year"], ["since"], F.col("since") <= F.col("year")) if where else retrieval.asked_terms(asks, "ask")
        both = retrieval.both_searches(docs, asked, "doc_id", 6, 50)
        alone = [] if where else [bm25(docs, asks, "doc_id", "ask", 4), retrieval.sparse_search(docs, asks, "doc_id", "ask", 4, 50)]
        return [sorted((tuple(x["ask"]), x["rank"], x["doc_id"], round(x["score"], 6)) for x in df.collect()) for df in (*both, *alone)]

    for where in (True, False):
        assert all(found := ranked(True, where)) and found == ranked(False, where)


def test_tasks_return_the_best_rows_alone(spark, monkeypatch):
    """One task reads all texts, in blocks of 7, and returns 3 rows a question; with few rows held at a time it returns more, but the same are best."""
    monkeypatch.setattr(block_scores, "TEXTS", 7)
    counts = {i: 1 + i * 7919 % 13 for i in range(400)}
    docs = spark.createDataFrame([(i, ["tax"] * n) for i, n in counts.items()], "doc_id long, terms array<string>").coalesce(1).withColumn("ok", F.lit(None).cast("array<boolean>"))
    asked = block_scores.asked_of({block_scores._slot("tax", 50): [(0, 1.0), (1, 2.0)]}, 50)
    best = sorted(counts, key=lambda i: (-counts[i], i))[:3]
    wanted = [(q, i, float(counts[i] * (q + 1))) for q in (0, 1) for i in best]

    def rows():
        return sorted(((r["__q"], r["doc_id"], r["score"]) for r in block_scores.best_rows(docs, "doc_id", [asked], 2, np.zeros(2, np.int64), 3).collect()), key=lambda r: (r[0], -r[2], r[1]))

    assert rows() == wanted
    monkeypatch.setattr(block_scores, "ROWS_HELD", 2)
    more = rows()
    assert len(more) > len(wanted) and [r for q in (0, 1) for r in [x for x in more if x[0] == q][:3]] == wanted


def test_texts_are_not_shuffled_for_many_pairs(spark):
    docs = spark.range(100_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("the tax "), F.when(F.col("id") % 1000 == 0, "rate").otherwise("law"), F.lit(" of it")).alias("text"))
    passages = spark.createDataFrame([(1, "the tax rate"), (2, "tax rate of")], "item_id int, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = retrieval.documents_holding(docs, passages, "doc_id", "item_id")
        assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect())) == sorted((k, i) for k in (1, 2) for i in range(0, 100_500, 1000))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# --- statistics


def test_statistics_follow_changes(spark):
    def snapshot(rows):
        return spark.createDataFrame(rows, "doc_id long, text string")

    versions = [
        [(1, "rate of tax"), (2, "tax on salary salary"), (3, None), (4, "gone word")],
        [(1, "rate of tax"), (2, "tax on rent"), (3, "now it has words"), (5, "new salary")],
        [(1, ""), (5, "new salary"), (6, None)],
        [],
    ]
    kept = statistics(snapshot(versions[0]))
    for before, after in zip(versions, versions[1:], strict=False):
        old, new = changed_rows(snapshot(before), snapshot(after), "doc_id")
        assert {r["doc_id"] for r in old.collect()} & {r["doc_id"] for r in new.collect()} <= {1, 2, 3}
        kept = merged(kept, change_of(old, new))
        counted = statistics(snapshot(after))
        assert sorted(kept.df.collect()) == sorted(counted.df.collect()) and kept.totals.collect() == counted.totals.collect()
        queries = spark.createDataFrame([(1, "salary tax"), (2, "words")], "q long, text string")
        stored, plain = (bm25(snapshot(after), queries, "doc_id", "q", 3, s).collect() for s in (kept.for_search(), None))
        assert sorted(stored) == sorted(plain)


# --- snapshot table


@pytest.fixture
def held(spark):
    t = SnapshotTable(spark, shared_folder(spark, "test"), "id", 16)
    t.create(spark.range(400).select("id", F.concat(F.lit("v"), "id").alias("v")))
    return t


def data_files(t):
    return {f"{name}/{b}/{x}" for name in t.files.names() if name.startswith("data-") for b in Files(t.spark, f"{t.path}/{name}").names() if b.startswith("__bucket") for x in Files(t.spark, f"{t.path}/{name}/{b}").names() if x.endswith(".parquet")}


def test_upsert_rewrites_touched_buckets_alone(spark, held):
    before, manifest = data_files(held), latest(held.files)[1]
    changes = spark.createDataFrame([(3, "three"), (1000, "new")], "id long, v string")
    version, touched = held.upsert(changes, spark.createDataFrame([(5,), (7777,)], "id long"))
    assert version == 2 and 1 <= len(touched) <= 4
    added = data_files(held) - before
    assert {int(f.split("__bucket=")[1].split("/")[0]) for f in added} <= set(touched)
    after = latest(held.files)[1]
    assert {b for b in manifest["buckets"] if manifest["buckets"][b] != after["buckets"].get(b)} == {str(b) for b in touched}
    want = {i: f"v{i}" for i in range(400) if i != 5} | {3: "three", 1000: "new"}
    assert {r["id"]: r["v"] for r in held.read().collect()} == want
    assert {r["id"]: r["v"] for r in held.read(1).collect()} == {i: f"v{i}" for i in range(400)}


def test_unknown_ids_change_nothing(spark, held):
    with pytest.raises(UnknownIds, match="1000"):
        held.upsert(spark.createDataFrame([(3, "three"), (1000, "new")], "id long, v string"), only_known=True)
    assert latest(held.files)[0] == 1 and held.read().count() == 400
    assert held.upsert(spark.createDataFrame([(3, "three")], "id long, v string"), only_known=True)[0] == 2


def test_torn_and_late_commits(spark, held):
    held.files.write(".draft-torn", '{"buckets": {"0": "da')  # a writer died while it wrote
    spark.range(5).write.parquet(f"{held.path}/data-orphan")  # or before it committed
    assert latest(held.files)[0] == 1 and held.read().count() == 400
    with pytest.raises(Conflict):
        commit(held.files, 1, {})
    assert latest(held.files)[1]["buckets"] and not [n for n in held.files.names() if n.startswith(".draft") and n != ".draft-torn"]
    held.upsert(spark.createDataFrame([], "id long, v string"))
    assert latest(held.files)[0] == 2 and held.read().count() == 400


def test_table_of_nothing(spark):
    t = SnapshotTable(spark, shared_folder(spark, "none"), "id", 4)
    assert latest(t.files) == (0, {})
    t.create(spark.createDataFrame([], "id long, v string"))
    assert t.read().collect() == [] and t.upsert(spark.createDataFrame([(1, None)], "id long, v string"))[0] == 2 and [tuple(r) for r in t.read().collect()] == [(1, None)]
