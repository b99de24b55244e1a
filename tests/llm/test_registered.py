"""The registered queries against DuckDB, and the pipeline against plain checks, on the smallest tables."""

import glob
import math
import os
from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline
from tessera.llm.registry import ORACLE, QUERIES
from tests.llm.test_operators import jaccard_links

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else repr(round(v, 6) + 0.0)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cur = con.execute(ORACLE[name])
    order = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(order) == columns
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[order[c]]) for c in columns) for r in cur.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        stage(spark, now, SF).write.mode("overwrite").parquet(path)
        now = spark.read.parquet(path)
        assert now.columns == columns
        seen[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {i for i, t in texts.items() if i not in seen["language"] and any(c.isalpha() for c in t or "") and len(t) > 200} == set()
    groups = defaultdict(list)
    for i, t in seen["language"].items():
        groups[t].append(i)
    assert set(seen["exact_dedup"]) == {max(g) for g in groups.values()}
    links = jaccard_links(list(seen["exact_dedup"].items()))
    left = set(seen["near_dedup"])
    assert not [p for p in links if set(p) <= left]
    linked = {x for p in links for x in p}
    assert set(seen["exact_dedup"]) - linked <= left
    assert 0 < len(seen["mix"]) < len(seen["near_dedup"]) and set(seen["mix"]) <= left
    rows = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert {r["doc_id"] for r in rows} == set(seen["mix"])
    again = corpus_pipeline.run(spark, SF).collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(tuple(r)[:5] for r in again)
