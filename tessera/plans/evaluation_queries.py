"""Queries that evaluate: eight set-ups over shared lists, excerpts for judges, verdicts of translations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.evaluation import gold_excerpts, graded_metrics, inherited_verdicts, run_setups, summary_by_group
from tessera.operators.retrieval import asked_terms, both_searches, documents_holding
from tessera.plans.answering import keyword_score
from tessera.plans.fixtures import Fixture, Made
from tessera.plans.registering import Book
from tessera.plans.retrieval_queries import _BM25, _SPARSE
from tessera.sources.shared import written
from tessera.sources.tables import table

book = Book()
QUERIES, ORACLE = book.QUERIES, book.ORACLE

#: Each benchmark item in three wordings: as it is, its first half, its second half.
ASKED = Made("SELECT item_id * 10 + v AS ask_id, item_id, v, CASE v WHEN 0 THEN text WHEN 1 THEN substr(text, 1, CAST(floor(length(text) / 2) AS INT)) ELSE substr(text, CAST(floor(length(text) / 2) AS INT) + 1) END AS text FROM {benchmark} CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2) k")
SETUPS = Fixture("setup string, lists array<string>, candidates int, rerank string", [
    ("lookup", ["sparse-0", "bm25-0"], 30, None), ("lookup-rerank", ["sparse-0", "bm25-0"], 30, "question"), ("rewrite", ["sparse-0", "bm25-0", "sparse-1", "bm25-1"], 30, None), ("rewrite-rerank", ["sparse-0", "bm25-0", "sparse-1", "bm25-1"], 30, "question"),
    ("full", ["sparse-0", "bm25-0", "sparse-1", "bm25-1", "sparse-2", "bm25-2"], 30, "question"), ("full-max", ["sparse-0", "bm25-0", "sparse-1", "bm25-1", "sparse-2", "bm25-2"], 30, "max"), ("fast", ["sparse-0", "bm25-0", "sparse-1", "bm25-1", "sparse-2", "bm25-2"], 15, "max"), ("fast-nodef", ["sparse-0", "bm25-0", "sparse-1", "bm25-1"], 15, "max"),
])
_WORDS = "list_filter(list_distinct(string_split_regex(lower({q}), '\\s+')), lambda w: length(w) > 4)"
_SCORE = f"CASE WHEN len({_WORDS}) = 0 THEN 0.0 ELSE round(len(list_filter({_WORDS}, lambda w: contains(lower(d.text), w))) / len({_WORDS}), 6) END"
_RELEVANT = """gold AS (SELECT b.item_id, d.doc_id, d.lang FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.item_id % 10 <> 9),
    relevant AS (SELECT item_id, doc_id, max(g) AS gold FROM (SELECT item_id, doc_id, true AS g FROM gold UNION ALL SELECT item_id, d.doc_id, false FROM gold JOIN documents d ON d.doc_id = gold.doc_id + 1) GROUP BY ALL)"""


@book.query(f"""WITH q AS (SELECT ask_id AS item_id, text FROM {ASKED.duck()}), {(_BM25 + ',' + _SPARSE).replace('FROM benchmark', 'FROM q')},
    lists AS (SELECT 'bm25-' || item_id % 10 AS list, item_id // 10 AS item_id, doc_id, rank FROM bmr WHERE rank <= 30 UNION ALL SELECT 'sparse-' || item_id % 10, item_id // 10, doc_id, rank FROM spr WHERE rank <= 30),
    each AS (SELECT p.item_id, p.doc_id, a.v, {_SCORE.format(q='a.text')} AS score FROM (SELECT DISTINCT item_id, doc_id FROM lists) p JOIN {ASKED.duck()} a USING (item_id) JOIN documents d USING (doc_id)),
    scores AS (SELECT 'question' AS kind, item_id, doc_id, max(CASE WHEN v = 0 THEN score END) AS score FROM each GROUP BY ALL UNION ALL SELECT 'max', item_id, doc_id, max(score) FROM each GROUP BY ALL),
    uses AS (SELECT setup, candidates, rerank, unnest(lists) AS list, generate_subscripts(lists, 1) AS place FROM {SETUPS.duck()}),
    f AS (SELECT setup, candidates, rerank, item_id, doc_id, round(sum(1 / (60 + rank)), 9) AS fused, min(place * 1000 + rank) AS first FROM lists JOIN uses USING (list) GROUP BY ALL),
    c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY setup, item_id ORDER BY fused DESC, first, doc_id) AS place FROM f) WHERE place <= candidates),
    r AS (SELECT setup, c.item_id, c.doc_id, row_number() OVER (PARTITION BY setup, c.item_id ORDER BY coalesce(score, 0.0) DESC, place) AS rank FROM c LEFT JOIN scores s ON s.kind = c.rerank AND s.item_id = c.item_id AND s.doc_id = c.doc_id),
    {_RELEVANT}, n AS (SELECT item_id, sum(gold::INT) AS g FROM relevant GROUP BY item_id HAVING sum(gold::INT) > 0),
    m AS (SELECT setup, item_id, max((rank <= 5)::INT::DOUBLE) AS hit, count(CASE WHEN gold AND rank <= 5 THEN 1 END) AS k, min(CASE WHEN rank <= 10 THEN rank END) AS best FROM r JOIN relevant USING (item_id, doc_id) GROUP BY ALL),
    e AS (SELECT s.setup, n.item_id, coalesce(hit, 0) AS hit, coalesce(k, 0) / g AS recall, coalesce(1.0::DOUBLE / best, 0) AS rr, l.lang FROM {SETUPS.duck()} s CROSS JOIN n JOIN (SELECT item_id, arg_min(lang, doc_id) AS lang FROM gold GROUP BY item_id) l USING (item_id) LEFT JOIN m ON m.setup = s.setup AND m.item_id = n.item_id)
    SELECT setup, CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, round(avg(hit), 4) AS hit, round(avg(recall), 4) AS recall, round(avg(rr), 4) AS rr, count(*) AS n FROM e GROUP BY GROUPING SETS ((setup, lang), (setup))""")
def evaluated_setups(spark: SparkSession, d: str) -> DataFrame:
    """Hit@5, recall@5 and MRR@10 of eight set-ups by language. Documents that follow a gold one are acceptable; every tenth item is out of
    scope."""
    docs, asks, items = table(spark, d, "documents"), ASKED.spark(spark, d), table(spark, d, "benchmark")
    sparse, words = both_searches(docs, asked_terms(asks, "ask_id"), "doc_id", 30)
    named = [r.select(F.concat(F.lit(f"{n}-"), F.col("ask_id") % 10).alias("list"), F.expr("ask_id div 10").alias("item_id"), "doc_id", "rank") for n, r in (("sparse", sparse), ("bm25", words))]
    lists = written(named[0].unionByName(named[1]), "lists")
    wordings = asks.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("v", "text"))), lambda a: a["text"]).alias("asked"))  # three an item
    pairs = lists.select("item_id", "doc_id").distinct().join(wordings, "item_id").join(docs.select("doc_id", "text"), "doc_id")
    scored = pairs.select("item_id", "doc_id", F.transform("asked", lambda q: keyword_score(q, F.col("text"))).alias("s"))
    each = written(scored.select("item_id", "doc_id", F.get("s", F.lit(0)).alias("question"), F.array_max("s").alias("max")), "scores")
    scores = each.select("item_id", "doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("score")) for k in ("question", "max")])).alias("s")).select("s.kind", "item_id", "doc_id", "s.score")
    ranked = run_setups(SETUPS.spark(spark), lists, scores, "item_id", "doc_id")
    gold = written(documents_holding(docs, items.filter("item_id % 10 <> 9"), "doc_id", "item_id").join(docs.select("doc_id", "lang"), "doc_id"), "gold")
    following = gold.select("item_id", (F.col("doc_id") + 1).alias("doc_id")).join(docs.select("doc_id"), "doc_id")
    relevant = gold.select("item_id", "doc_id", F.lit(True).alias("gold")).unionByName(following.select("item_id", "doc_id", F.lit(False).alias("gold")))
    lang = gold.groupBy("item_id").agg(F.min_by("lang", "doc_id").alias("lang"))
    rows = graded_metrics(ranked, relevant, ["setup"], "item_id", "doc_id").join(lang, "item_id")
    return summary_by_group(rows, ["setup"], "lang", ["hit", "recall", "rr"])


#: Six documents are a section; an item asks with the beginning of a section's first text, and its gold sections are this one and the two after it.
CHUNKS = Made("SELECT CAST(floor(doc_id / 6) AS BIGINT) AS section_id, doc_id AS ord, concat('d', doc_id) AS chunk_id, coalesce(text, '') AS text, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS n_tokens FROM {documents}")
ITEMS = Made("SELECT CAST(floor(doc_id / 6) AS BIGINT) AS item_id, substr(coalesce(min_by(text, doc_id), ''), 1, 300) AS text, array(CAST(floor(min(doc_id) / 6) AS BIGINT), CAST(floor(min(doc_id) / 6) AS BIGINT) + 2, CAST(floor(min(doc_id) / 6) AS BIGINT) + 1) AS gold FROM {documents} GROUP BY floor(doc_id / 6)")
_SPLIT = "regexp_extract_all(lower({t}), '[a-z]+')"
_PAIRS = "list_distinct(list_filter(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1]), lambda p: regexp_matches(p, '[a-z]{{4,}}')))"
_FOURS = "list_distinct(regexp_extract_all(lower({t}), '[a-z]{{4,}}'))"


@book.query(f"""WITH RECURSIVE i AS (SELECT item_id, {_PAIRS.format()} AS p, w, unnest(gold) AS section_id, generate_subscripts(gold, 1) AS g FROM (SELECT item_id, gold, {_SPLIT.format(t='text')} AS x, {_FOURS.format(t='text')} AS w FROM {ITEMS.duck()})),
    c AS (SELECT *, {_PAIRS.format()} AS cp FROM (SELECT *, {_SPLIT.format(t='text')} AS x, {_FOURS.format(t='text')} AS cw FROM {CHUNKS.duck()})),
    r AS (SELECT item_id, g, ord, chunk_id, n_tokens AS t, sum(n_tokens) OVER (PARTITION BY item_id) AS total, len(list_intersect(p, cp)) AS np, len(list_intersect(w, cw)) AS nw FROM i JOIN c USING (section_id)),
    b AS (SELECT *, row_number() OVER (PARTITION BY item_id, g ORDER BY np DESC, nw DESC, ord) = 1 AS best, row_number() OVER (PARTITION BY item_id ORDER BY np DESC, nw DESC, g, ord) AS k FROM r),
    f AS (SELECT item_id, 0::BIGINT AS k, sum(CASE WHEN best THEN t ELSE 0 END)::HUGEINT AS size, NULL::VARCHAR AS chunk_id, 0::BIGINT AS g, 0::BIGINT AS ord FROM b GROUP BY item_id
      UNION ALL SELECT b.item_id, b.k, CASE WHEN NOT best AND size + t <= 3000 THEN size + t ELSE size END, CASE WHEN total <= 3000 OR best OR size + t <= 3000 THEN b.chunk_id END, b.g, b.ord FROM f JOIN b ON b.item_id = f.item_id AND b.k = f.k + 1)
    SELECT item_id, chunk_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY g, ord) AS INTEGER) AS place FROM f WHERE chunk_id IS NOT NULL""")
def gold_section_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of each item's gold sections within 3,000 tokens: the best of every section, then by shared words."""
    return gold_excerpts(ITEMS.spark(spark, d), CHUNKS.spark(spark, d), "item_id", 3000)


#: Customers as items: chains of translations of up to three, circles of two, sources that are not there.
TRANSLATED = Made("SELECT concat('i', c_custkey) AS id, CASE WHEN c_custkey % 50 = 46 THEN concat('i', c_custkey + 1) WHEN c_custkey % 50 = 47 THEN concat('i', c_custkey - 1) WHEN c_custkey % 50 = 10 THEN concat('x', c_custkey) WHEN c_custkey % 4 > 0 THEN concat('i', c_custkey - 1) END AS source_id, c_custkey % 7 > 0 AS language_ok FROM {customer}")
JUDGED = Made("SELECT concat('i', c_custkey) AS id, c_acctbal >= 0 AS ok, CASE WHEN c_acctbal < 0 THEN array('judge: faithful = no') ELSE array() END AS reasons, CASE WHEN c_nationkey % 3 = 0 THEN 'agree' WHEN c_nationkey % 3 = 1 THEN 'disagree' END AS second_opinion FROM {customer} WHERE c_custkey % 4 = 0 AND c_custkey % 50 NOT IN (46, 47, 10) AND c_custkey % 9 > 0")


@book.query(f"""WITH RECURSIVE t AS (SELECT * FROM {TRANSLATED.duck()}),
    v AS (SELECT t.id, coalesce(ok, false) AS ok, CASE WHEN j.id IS NULL THEN 'not verified' ELSE array_to_string(reasons, '; ') END AS reasons, second_opinion, NULL::VARCHAR AS inherited_from FROM t LEFT JOIN {JUDGED.duck()} j USING (id) WHERE source_id IS NULL
      UNION ALL SELECT t.id, false, 'source question ' || source_id || ' not verified' || CASE WHEN language_ok THEN '' ELSE '; translation wording not checked by a native speaker yet' END, NULL, source_id FROM t WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT id FROM t)
      UNION ALL SELECT t.id, v.ok AND language_ok, array_to_string(list_filter([CASE WHEN NOT v.ok THEN 'source question ' || source_id || ' is flagged' END, CASE WHEN NOT language_ok THEN 'translation wording not checked by a native speaker yet' END], lambda x: x IS NOT NULL), '; '), v.second_opinion, source_id FROM v JOIN t ON t.source_id = v.id)
    SELECT * FROM v UNION ALL SELECT id, false, 'source questions go in a circle' || CASE WHEN language_ok THEN '' ELSE '; translation wording not checked by a native speaker yet' END, NULL, source_id FROM t WHERE id NOT IN (SELECT id FROM v)""")
def translated_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of items and, along chains, of their translations; circles are reported."""
    return inherited_verdicts(TRANSLATED.spark(spark, d), JUDGED.spark(spark, d)).withColumn("reasons", F.array_join("reasons", "; "))
