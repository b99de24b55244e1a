"""Connected components of a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stash


def _star(edges: DataFrame, large: bool, rows: int | None) -> DataFrame:
    """Link each node's neighbours (larger ones in a large step, smaller ones in a small step) to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", rows)
    linked = both.join(least, "u")
    if large:
        new = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return new.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component) for every node of edges (u, v); a component is named by its least node. Nodes may be of any type
    that has an order; rows: about how many there are at most (see stash). Loops are left out; repeated edges, and edges both ways, count once; no edges give no rows.

    Each round halves the depth of the trees that the links form, so the rounds grow with the logarithm of the longest
    chain; they go on until all trees are stars, where no node's parent has a parent. Every round is written to the
    shared folder. Minima are summed up in each task first and written, so that the join back is a plain inner
    equi-join, which adaptive execution splits at a node with very many neighbours.
    """
    now = stash(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", rows)
    while True:
        now = stash(_star(stash(_star(now, True, rows), "edges", rows), False, rows), "edges", rows)
        if not now.join(now.select(F.col("u").alias("v")), "v", "left_semi").head(1):
            break
    named = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return named.unionByName(named.select(F.col("component").alias("node"), "component").distinct())
