"""Queries over indexes: filtered vector search by an inverted file, and terms by an automaton."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.index_stats import Statistics, change_of, changed_rows, merged, statistics
from tessera.operators.ordered import numbered
from tessera.operators.retrieval import bm25, idf_of
from tessera.operators.term_match import terms_in
from tessera.operators.vector_index import choose_probes, filtered_knn, fit_centroids, index_vectors, recall_of
from tessera.plans.fixtures import Made
from tessera.plans.registering import Book
from tessera.plans.retrieval_queries import ORACLE as RETRIEVAL
from tessera.sources.shared import shared_folder
from tessera.sources.snapshots import SnapshotTable
from tessera.sources.tables import table

book = Book()
QUERIES, ORACLE = book.QUERIES, book.ORACLE

#: Each vector with a validity and a law.
_VALID = Made("""(SELECT vec_id, label, embedding, CAST(2018 + vec_id % 5 AS INT) AS valid_from, CAST(CASE WHEN vec_id % 3 > 0 THEN 2018 + vec_id % 5 + vec_id % 4 END AS INT) AS valid_to, concat('L', CAST(label % 4 AS STRING)) AS law FROM {embeddings})""")
#: The query set: vectors whose id is divisible by 100, four of five with a year, every other one with laws.
_QUERIES = Made("""(SELECT vec_id AS id, embedding AS v, CAST(CASE WHEN vec_id % 500 > 0 THEN 2020 + vec_id % 3 END AS INT) AS year, CASE WHEN vec_id % 200 > 0 THEN array('L1', 'L2') END AS laws FROM {embeddings} WHERE vec_id % 100 = 0)""")
#: Other vectors as queries, to tune the number of lists on.
_TUNING = Made("(" + _QUERIES.sql[1:-1].replace("vec_id % 100 = 0", "vec_id % 25 = 10 AND vec_id < 25000") + ")")


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, np.ndarray]:
    vectors = _VALID.spark(spark, d)
    centroids = fit_centroids(vectors, "vec_id", "embedding", max(1, round(vectors.count() ** 0.5)))
    return index_vectors(vectors, "vec_id", "embedding", centroids, [F.col("valid_from"), F.col("valid_to"), F.col("law")]), centroids


_EXACT = f"""WITH q AS (SELECT * FROM {_QUERIES.duck()}), h AS (SELECT * FROM {_VALID.duck()}),
    p AS (SELECT id AS query_id, vec_id AS id, list_transform(v, lambda x: x::DOUBLE) AS a, list_transform(embedding, lambda x: x::DOUBLE) AS b FROM q JOIN h ON vec_id <> id AND (year IS NULL OR (valid_from <= year AND coalesce(valid_to >= year, true))) AND (laws IS NULL OR list_contains(laws, law))),
    s AS (SELECT query_id, id, round(list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b))), 6) AS score FROM p),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s)"""


@book.query(f"{_EXACT} SELECT query_id, id, score, rank FROM r WHERE rank <= 10")
def filtered_knn_exact(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors that hold in a query's year and belong to its laws, by all lists of an inverted file."""
    index, centroids = _index(spark, d)
    return filtered_knn(index, _QUERIES.spark(spark, d), centroids, 10)


@book.query(f"{_EXACT} SELECT count(DISTINCT query_id) AS n_queries, true AS recalled FROM r WHERE rank <= 10")
def filtered_knn_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the nearest lists alone hold nine tenths of the exact neighbours under the same filters."""
    (index, centroids), queries = _index(spark, d), _QUERIES.spark(spark, d)
    probes = choose_probes(index, _TUNING.spark(spark, d), centroids, 10, 0.95)
    exact, near = filtered_knn(index, queries, centroids, 10), filtered_knn(index, queries, centroids, 10, probes)
    return recall_of(near, exact).select("n_queries", (F.col("recall") >= 0.9).alias("recalled"))


@book.query(r"""WITH w AS (SELECT string_split(lower(text), ' ') AS s FROM conversations), g AS (SELECT DISTINCT s[i] || ' ' || s[i + 1] AS phrase FROM (SELECT s, unnest(range(1, len(s))) AS i FROM w)),
    terms AS (SELECT phrase, row_number() OVER (ORDER BY phrase) AS ord FROM g WHERE regexp_full_match(phrase, '[a-z]+ [a-z]+')),
    runs AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+|[^a-z]+') AS r FROM documents),
    pairs AS (SELECT doc_id, i, r[i] || ' ' || r[i + 2] AS pair, length(r[i + 2]) AS n FROM (SELECT doc_id, r, unnest(range(1, len(r) - 1)) AS i FROM runs) WHERE r[i + 1] = ' '),
    cut AS (SELECT doc_id, i, pair, left(pair, length(pair) - k) AS phrase FROM pairs, range(4) c(k) WHERE k < n AND (k = 0 OR length(pair) - k >= 5)),
    hit AS (SELECT doc_id, ord, arg_min(pair, i) AS term FROM cut JOIN terms USING (phrase) GROUP BY ALL),
    top AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY length(term) DESC, ord) AS INTEGER) AS rank FROM hit)
    SELECT doc_id, ord, term, rank FROM top WHERE rank <= 15""")
def phrases_in_documents(spark: SparkSession, d: str) -> DataFrame:
    """The longest phrases of the conversations, up to 15, that each document holds, the last word with an ending of up to three letters."""
    words = F.split(F.lower("text"), " ")
    pairs = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    said = table(spark, d, "conversations").filter("text IS NOT NULL").select(F.explode(pairs).alias("phrase"))
    phrases = said.filter(F.col("phrase").rlike("^[a-z]+ [a-z]+$")).distinct()
    glossary = numbered(phrases, "phrase").select((F.col("ord") + 1).alias("ord"), F.array("phrase").alias("roman"), F.lit(None).cast("array<string>").alias("urdu"))
    return terms_in(table(spark, d, "documents"), "doc_id", glossary, 15)


#: The documents as they were: some with other words, some that are gone now, and without those that are new.
_BEFORE = Made("""(SELECT CASE WHEN doc_id % 11 = 0 THEN -1 - doc_id ELSE doc_id END AS doc_id, CASE WHEN doc_id % 7 = 0 THEN concat(coalesce(text, ''), ' words as they were') ELSE text END AS text FROM {documents} WHERE doc_id % 13 > 0)""")


def _stored(spark: SparkSession, d: str) -> Statistics:
    """Statistics of the snapshot before, changed to those of the documents as they are."""
    before, after = _BEFORE.spark(spark, d), table(spark, d, "documents").select("doc_id", "text")
    return merged(statistics(before), change_of(*changed_rows(before, after, "doc_id")))


@book.query(RETRIEVAL["bm25_idf"].replace(", round(ln(", ", (SELECT count(*) FROM documents) AS n, round(ln("))
def stored_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies and idf from statistics that were kept and changed, not counted again."""
    found = _stored(spark, d)
    return found.df.crossJoin(F.broadcast(found.totals)).select("term", "df", "n", F.round(idf_of(F.col("n"), F.col("df")), 6).alias("idf"))  # totals: one row


@book.query(RETRIEVAL["bm25_topk"])
def bm25_stored_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The five best documents of each benchmark item, by stored statistics."""
    return bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", 5, _stored(spark, d).for_search())


@book.query("""SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 7 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderkey % 50 = 7 AS changed FROM orders WHERE o_orderkey % 100 <> 3 UNION ALL SELECT -1 - o_orderkey, o_totalprice, true FROM orders WHERE o_orderkey % 200 = 9""")
def bucketed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Orders in buckets after a commit that changes, adds and deletes some."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit(False).alias("changed"))
    held = SnapshotTable(spark, shared_folder(spark, "orders"), "o_orderkey", 32)
    held.create(orders)
    some = orders.withColumn("changed", F.lit(True))
    changes = some.filter("o_orderkey % 50 = 7").withColumn("o_totalprice", F.col("o_totalprice") + 1).unionByName(some.filter("o_orderkey % 200 = 9").withColumn("o_orderkey", -1 - F.col("o_orderkey")))
    held.upsert(changes, orders.filter("o_orderkey % 100 = 3"))
    return held.read()
