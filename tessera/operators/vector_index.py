"""An inverted file of vectors: lists around coarse centroids, filtered search in the nearest lists, exact scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tessera.operators.retrieval import top_k
from tessera.operators.sizes import small
from tessera.sources.shared import written

#: Rows of a list that one block holds, and queries that meet a block together.
LIST_BLOCK, QUERY_BLOCK = 4096, 256
#: Vectors for each centroid that the centroids are fitted on, at most: a bounded sample, by the hash of the key.
FIT_ROWS = 256
#: Most centroids: what is broadcast is their number times the dimension, 8 bytes each.
MOST_LISTS = 8192


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def fit_centroids(vectors: DataFrame, key: str, vector: str, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of at most `lists` lists, by k-means with cosine on at most FIT_ROWS * lists vectors, chosen by hash.

    A list that loses all its vectors takes one that lies far from its own centroid."""
    lists = min(lists, MOST_LISTS)
    rows = vectors.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(F.col(key)), key).limit(FIT_ROWS * lists).select(F.col(vector).cast("array<double>").alias("v")).collect()
    if not rows:
        return np.zeros((0, 0))
    m = _unit(np.array([r["v"] for r in rows], float))
    lists = min(lists, len(m))
    centroids = m[np.random.default_rng(seed).permutation(len(m))[:lists]]
    for _ in range(rounds):
        score = m @ centroids.T
        own = score.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, m)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        sums[empty] = m[np.argsort(score[np.arange(len(m)), own], kind="stable")[: len(empty)]]
        centroids = _unit(sums)
    return centroids


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), -1)


def _nearest_lists(centroids: np.ndarray, probes: int):
    """Rows to their `probes` nearest lists, nearest first: (row, lists)."""

    def run(batches):
        for b in batches:
            score = _unit(_matrix(b.column("v"))) @ centroids.T
            order = np.argsort(-score, axis=1, kind="stable")[:, :probes].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(order.tolist(), pa.list_(pa.int32()))], names=[*b.schema.names, "lists"])

    return run


def _with_lists(rows: DataFrame) -> StructType:
    return StructType([*rows.schema.fields, StructField("lists", ArrayType(IntegerType()))])


def index_vectors(vectors: DataFrame, key: str, vector: str, centroids: np.ndarray, payload: list[Column]) -> DataFrame:
    """list, block, id, v and the payload columns of every vector, written. A list of any length, be it a third of all rows, is cut into
    blocks of about LIST_BLOCK rows by the hash of the key. Null vectors are left out."""
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), *payload)
    dealt = rows.mapInArrow(_nearest_lists(centroids, 1), _with_lists(rows))
    dealt = written(dealt.withColumn("list", F.get("lists", F.lit(0))).drop("lists"), "vectors")
    sizes = dealt.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_BLOCK).cast("int").alias("blocks"))
    return dealt.join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))  # one row a list: MOST_LISTS at most


def _best(b: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of a block for each of its queries, of those that the filter of the query leaves."""
    for asked, held in zip(b.column("asked").to_pylist(), b.column("held").to_pylist(), strict=True):
        qi, vi = np.array([r["id"] for r in asked]), np.array([r["id"] for r in held])
        qm, vm = np.array([r["v"] for r in asked]), np.array([r["v"] for r in held])
        norms = np.linalg.norm(qm, axis=1)[:, None] * np.linalg.norm(vm, axis=1)[None, :]
        score = np.round(np.divide(qm @ vm.T, norms, out=np.zeros_like(norms), where=norms > 0), 6) + 0.0
        begin = np.array([-np.inf if r["valid_from"] is None else r["valid_from"] for r in held])
        end = np.array([np.inf if r["valid_to"] is None else r["valid_to"] for r in held])
        laws = np.array([r["law"] or "" for r in held])
        for i, q in enumerate(asked):
            left = vi != qi[i]
            if q["year"] is not None:
                left &= (begin <= q["year"]) & (q["year"] <= end)
            if q["laws"] is not None:
                left &= np.isin(laws, q["laws"])
            at = np.flatnonzero(left)
            best = at[np.lexsort((vi[at], -score[i, at]))[:k]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), qi[i])), pa.array(vi[best]), pa.array(score[i, best])], names=["query_id", "id", "score"])


def _in_lists(index: DataFrame, probed: DataFrame, k: int) -> DataFrame:
    """query_id, id, score of the k best of each block of each probed list (id, v, year, laws, list)."""
    held = index.groupBy("list", "block", "blocks").agg(F.collect_list(F.struct("id", "v", "valid_from", "valid_to", "law")).alias("held"))
    n = small(probed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("parts")))
    asked = probed.join(n, "list").groupBy("list", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("id", "v", "year", "laws")).alias("asked"))
    blocks = index.select("list", "block").distinct()
    met = asked.join(small(blocks), "list").join(held, ["list", "block"]).select("asked", "held")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):  # a pair of blocks at a time
                yield from _best(b.slice(i, 1), k)

    return met.mapInArrow(run, "query_id long, id long, score double")


def filtered_knn(index: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int, probes: int | None = None) -> DataFrame:
    """query_id, id, score (cosine, 6 digits), rank: the k nearest vectors of each query, itself left out, of those whose validity holds
    the query's year and whose law is one of the query's laws (null: any). queries: id, v, year, laws.

    Only the `probes` lists nearest to the query are searched, all of them where probes is not given, which is exact. The filter
    holds inside the lists, before the cut to k. A query that finds fewer than k there is searched in all other
    lists too, so a narrow filter never shortens a result."""
    n_lists = len(centroids)
    probes = n_lists if probes is None else min(probes, n_lists)
    rows = queries.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), F.col("year").cast("int").alias("year"), F.col("laws").cast("array<string>").alias("laws")).filter("v IS NOT NULL")
    if not n_lists:
        return rows.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    ordered = written(rows.mapInArrow(_nearest_lists(centroids, n_lists), _with_lists(rows)), "probes")
    near = ordered.select("id", "v", "year", "laws", F.explode(F.slice("lists", 1, probes)).alias("list"))
    found = top_k(_in_lists(index, near, k), ["query_id"], F.col("score"), ["id"], k)
    if probes == n_lists:
        return found
    found = written(found.drop("rank"), "found")
    short = ordered.join(found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n")), "id", "left").filter(F.coalesce("n", F.lit(0)) < k)
    rest = short.select("id", "v", "year", "laws", F.explode(F.slice("lists", probes + 1, n_lists)).alias("list"))
    return top_k(found.unionByName(_in_lists(index, rest, k)), ["query_id"], F.col("score"), ["id"], k)


def choose_probes(index: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int, target: float) -> int:
    """The fewest lists to search so that the share `target` of the exact neighbours of these queries (a bounded set to tune
    on, like those to come: id, v, year, laws) is found. Vectors without clusters need most lists, clustered ones few."""
    exact = filtered_knn(index, queries, centroids, k).select(F.col("query_id").alias("qid"), F.col("id").alias("near"))
    asked = queries.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).filter("v IS NOT NULL")
    order = asked.mapInArrow(_nearest_lists(centroids, len(centroids)), _with_lists(asked)).select(F.col("id").alias("qid"), "lists")
    at = exact.join(index.select(F.col("id").alias("near"), "list"), "near").join(order, "qid").select(F.array_position("lists", F.col("list")).alias("at"))
    counts = sorted(tuple(r) for r in at.groupBy("at").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a list at most
    total, held = sum(n for _, n in counts), 0
    for place, n in counts:
        held += n
        if held >= target * total:
            return int(place)
    return max(1, len(centroids))


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """n_queries, recall: the share of the exact rows that were found, over all queries."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg(F.count_distinct("query_id").alias("n_queries"), (F.count("hit") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("recall"))
