"""Queries over documents, benchmark items and embeddings: index statistics, search, fusion, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import STOPWORDS, tokens
from tessera.operators.retrieval import asked_terms, bm25, both_searches, dense_knn, documents_holding, fuse, idf_of, means_with_total, ranking_metrics, sparse_search, term_stats
from tessera.sources.tables import table


def doc_term_stats(spark: SparkSession, d: str) -> DataFrame:
    """Words and distinct words of every document."""
    s = term_stats(table(spark, d, "documents"), "doc_id", "text")
    return s.select("doc_id", F.col("doc_len").cast("long").alias("doc_len"), F.size(F.array_distinct("terms")).cast("long").alias("n_terms"))


def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and idf of every term."""
    docs = table(spark, d, "documents")
    df = docs.select(F.explode_outer(F.array_distinct(tokens(F.col("text")))).alias("term")).filter("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(idf_of(F.col("n"), F.col("df")), 6).alias("idf"))


def _bm25(spark, d, k):
    return bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", k)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five best documents of each benchmark item."""
    return _bm25(spark, d, 5)


def sparse_dot_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five best documents of each benchmark item by hashed sparse vectors."""
    return sparse_search(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", 5)


def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """BM25 and sparse lists of 30 documents fused to ten."""
    sparse, words = both_searches(table(spark, d, "documents"), asked_terms(table(spark, d, "benchmark"), "item_id"), "doc_id", 30)
    return fuse([words, sparse], "item_id", "doc_id", 10)


def _gold(spark, d):
    """Documents that hold an item's text, the natural answers."""
    docs = table(spark, d, "documents")
    return documents_holding(docs, table(spark, d, "benchmark"), "doc_id", "item_id").join(docs.select("doc_id", "lang"), "doc_id").select("item_id", "doc_id", "lang")


def hit_recall_mrr_by_lang(spark: SparkSession, d: str) -> DataFrame:
    """Hit@5, recall@5 and MRR@10 of BM25 by the language of an item's first gold document, and over all."""
    gold = _gold(spark, d)
    lang = gold.groupBy("item_id").agg(F.min_by("lang", "doc_id").alias("lang"))
    rows = ranking_metrics(_bm25(spark, d, 20), gold, "item_id", "doc_id").join(lang, "item_id")
    return means_with_total(rows, "lang", ["hit", "recall", "rr"])


def _knn(spark, d, k):
    v = table(spark, d, "embeddings")
    return dense_knn(v, v.filter("vec_id % 100 = 0"), "vec_id", "embedding", k)


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of each vector whose id is divisible by 100."""
    return _knn(spark, d, 10)


def knn_label_metrics(spark: SparkSession, d: str) -> DataFrame:
    """How often the ten nearest vectors have the query's label, by label and over all."""
    v = table(spark, d, "embeddings").select("vec_id", "label")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label"))
    rows = _knn(spark, d, 10).join(v, "vec_id").join(q, "query_id").groupBy("query_id", "q_label").agg(F.avg((F.col("label") == F.col("q_label")).cast("double")).alias("precision"))
    return means_with_total(rows.withColumn("label", F.col("q_label").cast("string")), "label", ["precision"])


QUERIES = {f.__name__: f for f in (doc_term_stats, bm25_idf, bm25_topk, sparse_dot_topk, rrf_hybrid, hit_recall_mrr_by_lang, dense_topk, knn_label_metrics)}

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_WORDS = rf"list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: w NOT IN ({_STOP}))"
_BM25 = f"""
toks AS (SELECT doc_id, {_WORDS} AS w FROM documents),
ask AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL),
tot AS (SELECT count(*) AS n, sum(len(w)) / greatest(count(*), 1) AS avgdl FROM toks),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM toks) WHERE term IN (SELECT term FROM ask) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT item_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
       FROM tf JOIN df USING (term) JOIN ask USING (term) CROSS JOIN tot GROUP BY ALL),
bmr AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM bm WHERE score > 0)"""
_LIMB = "(('0x' || substr(md5(w), {at}, 8))::BIGINT)"
_SLOT = "0"
for _at in (1, 9, 17, 25):
    _SLOT = f"(({_SLOT} * {(1 << 32) % 10000} + {_LIMB.format(at=_at)}) % 10000)"
_SPARSE = f"""
dv AS (SELECT doc_id, slot, count(*) AS weight FROM (SELECT doc_id, {_SLOT} AS slot FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents)) GROUP BY ALL),
qv AS (SELECT item_id, slot, count(*) AS qw FROM (SELECT item_id, {_SLOT} AS slot FROM (SELECT item_id, unnest({_WORDS}) AS w FROM benchmark)) GROUP BY ALL),
sp AS (SELECT item_id, doc_id, CAST(sum(weight * qw) AS DOUBLE) AS score FROM dv JOIN qv USING (slot) GROUP BY ALL),
spr AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sp)"""
_KNN = """
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))), 6) AS score, a.label AS ql, b.label AS bl
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)"""

ORACLE = {
    "doc_term_stats": f"SELECT doc_id, len(w) AS doc_len, len(list_distinct(w)) AS n_terms FROM (SELECT doc_id, {_WORDS} AS w FROM documents)",
    "bm25_idf": f"SELECT term, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM (SELECT unnest(list_distinct({_WORDS})) AS term FROM documents) GROUP BY term",
    "bm25_topk": f"WITH {_BM25} SELECT item_id, doc_id, score, rank FROM bmr WHERE rank <= 5",
    "sparse_dot_topk": f"WITH {_SPARSE} SELECT item_id, doc_id, score, rank FROM spr WHERE rank <= 5",
    "rrf_hybrid": f"""WITH {_BM25}, {_SPARSE},
        u AS (SELECT item_id, doc_id, 0 AS l, rank FROM bmr WHERE rank <= 30 UNION ALL SELECT item_id, doc_id, 1, rank FROM spr WHERE rank <= 30),
        f AS (SELECT item_id, doc_id, round(sum(1 / (60 + rank)), 9) AS score, min(l * 1000 + rank) AS first FROM u GROUP BY ALL)
        SELECT item_id, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first, doc_id) AS INTEGER) AS rank FROM f) WHERE rank <= 10""",
    "hit_recall_mrr_by_lang": f"""WITH {_BM25},
        gold AS (SELECT item_id, doc_id, lang FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
        l AS (SELECT item_id, arg_min(lang, doc_id) AS lang FROM gold GROUP BY item_id),
        m AS (SELECT item_id, count(CASE WHEN rank <= 5 THEN 1 END) AS k, count(*) AS g, min(CASE WHEN rank <= 10 THEN rank END) AS best
              FROM gold LEFT JOIN (SELECT * FROM bmr WHERE rank <= 20) x USING (item_id, doc_id) GROUP BY item_id)
        SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, round(avg((k > 0)::INT::DOUBLE), 4) AS hit, round(avg(k / g), 4) AS recall,
               round(avg(coalesce(1.0::DOUBLE / best, 0)), 4) AS rr, count(*) AS n FROM m JOIN l USING (item_id) GROUP BY GROUPING SETS ((lang), ())""",
    "dense_topk": f"WITH {_KNN} SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10",
    "knn_label_metrics": f"""WITH {_KNN}, p AS (SELECT query_id, ql::VARCHAR AS label, avg((bl = ql)::INT::DOUBLE) AS precision FROM r WHERE rank <= 10 GROUP BY ALL)
        SELECT CASE WHEN grouping(label) = 1 THEN 'all' ELSE label END AS label, round(avg(precision), 4) AS precision, count(*) AS n FROM p GROUP BY GROUPING SETS ((label), ())""",
}
