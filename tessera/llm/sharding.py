"""Weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import blocks_for, gapless_rank, packed, stash, utf8_bytes


def rendezvous_scores(key: Column, weights: Sequence[float]) -> list[Column]:
    """One score a shard, -ln(u) / weight with u in (0, 1) hashed from key and shard; the least score wins.

    A shard wins with probability weight / sum of weights, and a key's scores for the old shards do not change when
    a shard is added, so a record moves only if the new shard wins it.
    """
    base = F.xxhash64(F.coalesce(key.cast("string"), F.lit("\x00null")))
    unit = [(F.shiftrightunsigned(F.xxhash64(base, F.lit(j).cast("long")), 11).cast("double") + 0.5) / float(2**53) for j in range(len(weights))]
    return [-F.ln(u) / float(w) if w > 0 else F.lit(float("inf")) for u, w in zip(unit, weights, strict=True)]


def winner(scores: Column, n: int) -> Column:
    """Place of the least of the first n scores (the first of equal ones)."""
    head = F.slice(scores, 1, n)
    return (F.array_position(head, F.array_min(head)) - 1).cast("int")


def assign_shards(rows: DataFrame, key: str, n_shards: int, weights: Sequence[float] | None = None, grown: bool = True, out: str = "shard") -> DataFrame:
    """Add `out` (and `grown_<out>`: the shard after one more of mean weight joins); no shuffle, any columns pass through.

    Null keys share one shard, as any other equal keys do; repeated rows go to the same one. Empty tables give empty
    tables. Columns of other names pass through unchanged; a column that is already called `out` or grown_<out> is
    replaced.
    """
    weights = list(weights or [1.0] * n_shards)
    if len(weights) != n_shards or n_shards < 1 or min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("n_shards weights of 0 or more are needed, at least one above 0")
    more = [*weights, sum(weights) / n_shards] if grown else weights
    made = [out, f"grown_{out}"][: 1 + grown]
    scored = packed(rows.drop(*[c for c in made if c != key]), scores=F.array(*rendezvous_scores(F.col(key), more)))
    return scored.select("row.*", *[winner(F.col("scores"), n_shards + k).alias(c) for k, c in enumerate(made)])


def shard_documents(docs: DataFrame, n_shards: int = 40, weights: Sequence[float] | None = None, rows_per_block: int = 50_000) -> DataFrame:
    """Every document's shard by the law `key`, and its gapless slot there.

    size is the UTF-8 bytes of the text (null: none) plus 16, text_crc32 that of the bytes (null: of none). Only
    narrow columns are shuffled. Repeated rows get a slot each; null doc_ids are one key and share a shard.
    """
    narrow = docs.select("doc_id", (utf8_bytes(F.col("text")) + 16).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"))
    placed = stash(assign_shards(narrow, "doc_id", n_shards, weights), "shard-rows")  # scores are computed here, once
    blocks = blocks_for(placed.count(), n_shards, rows_per_block)
    ranked = gapless_rank(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot", blocks)
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
