"""The serving side: limits, quotas, caches, votes and the decision whether to answer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_quota(log: DataFrame, key: str, at: str, tie: str, limit: int) -> DataFrame:
    """The requests that a quota of `limit` a key and UTC day lets through; limit 0 or less lets all through."""
    if limit <= 0:
        return log
    day = F.to_date(at)
    return log.withColumn("__n", F.row_number().over(Window.partitionBy(key, day).orderBy(at, tie))).filter(F.col("__n") <= limit).drop("__n")


def sliding_limit(log: DataFrame, key: str, at: str, tie: str, limit: int, seconds: int) -> DataFrame:
    """Add `allowed`: fewer than `limit` allowed requests of the key lie in the `seconds` before (that far included).

    Only allowed requests count, so this is state and no window. A key's requests stream through in order, and the
    state is its last allowed times: a task never holds a key's whole log.
    """
    width = pd.Timedelta(seconds=seconds)
    names = log.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, hits = None, []
        for b in batches:
            allowed = []
            for k, t in zip(b[key], b[at], strict=True):
                if now is None or k != now[0]:
                    now, hits = (k,), []
                hits = [h for h in hits if h >= t - width]
                allowed.append(len(hits) < limit)
                if allowed[-1]:
                    hits.append(t)
            yield b.assign(allowed=allowed)

    schema = ", ".join(f"`{n}` {t}" for n, t in log.dtypes) + ", allowed boolean"
    return log.repartition(key).sortWithinPartitions(key, at, tie).select(*names).mapInPandas(run, schema)


def last_votes(votes: DataFrame, asks: DataFrame, key: str, at: str, tie: str, columns: list[str]) -> DataFrame:
    """The last vote on each known ask; votes on unknown asks are dropped."""
    known = votes.join(asks.select(key).distinct(), key, "left_semi")
    return known.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(at, tie)).alias("v")).select(key, "v.*")


def cache_hits(log: DataFrame, key: Column, at: list[str]) -> DataFrame:
    """key, first (the request that filled the cache), hits (the requests after it that it answered)."""
    return log.groupBy(key.alias("key")).agg(F.min(F.struct(*at)).alias("first"), (F.count(F.lit(1)) - 1).alias("hits"))


def refusal(scope: Column, year: Column, first_year: int, last_year: int, n_missing: Column, named: Column, n_candidates: Column, top: Column, threshold: float) -> Column:
    """Why a question is not answered, null if it is: the first rule that fails."""
    return (
        F.when(scope != "income_tax", "OUT_OF_SCOPE")
        .when((year < first_year) | (year > last_year), "TAX_YEAR_NOT_COVERED")
        .when((n_missing > 0) & ~named, "SECTION_NOT_FOUND")
        .when(n_candidates == 0, "NO_RELEVANT_SOURCES")
        .when((top < threshold) & ~named, "NO_RELEVANT_SOURCES")
    )


def flagged(score: Column, threshold: float = 0.5) -> Column:
    """A guard's verdict; a guard that gave none lets the question pass."""
    return F.coalesce(score >= threshold, F.lit(False))
