"""Statistics of an index that are kept, and changed by what a snapshot changes, instead of being counted again."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.sources.shared import written


class Statistics(NamedTuple):
    """totals: n, length (one row); df: term, df."""

    totals: DataFrame
    df: DataFrame

    def for_search(self) -> tuple[DataFrame, DataFrame]:
        """(n, avgdl) and (term, df), as `bm25` takes them."""
        return self.totals.select("n", (F.col("length") / F.greatest("n", F.lit(1))).alias("avgdl")), self.df


def _signed(docs: DataFrame, sign: int) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(tokens(F.col("text")).alias("terms"))
    totals = rows.select(F.lit(sign).cast("long").alias("n"), (F.coalesce(F.size("terms"), F.lit(0)) * sign).cast("long").alias("length"))
    terms = rows.select(F.explode_outer(F.array_distinct("terms")).alias("term")).filter("term IS NOT NULL").select("term", F.lit(sign).cast("long").alias("df"))
    return totals, terms


def _summed(totals: DataFrame, terms: DataFrame) -> Statistics:
    one = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))
    return Statistics(written(one, "totals"), written(terms.groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0"), "frequencies"))


def statistics(docs: DataFrame) -> Statistics:
    """Counted over all documents (column text; a null text has no words)."""
    return _summed(*_signed(docs, 1))


def change_of(before: DataFrame, after: DataFrame) -> Statistics:
    """What a change does to the statistics: the documents that it touches, as they were (none for new ones) and as
    they are (none for deleted ones). Counts are signed, so changes can be merged in any order."""
    (t1, w1), (t2, w2) = _signed(before, -1), _signed(after, 1)
    return _summed(t1.unionByName(t2), w1.unionByName(w2))


def merged(first: Statistics, *others: Statistics) -> Statistics:
    """Statistics with changes applied; terms that no document has any more are left out."""
    totals, terms = first
    for o in others:
        totals, terms = totals.unionByName(o.totals), terms.unionByName(o.df)
    return _summed(totals, terms)


def changed_rows(before: DataFrame, after: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Of two snapshots (key, text), the rows that differ, as they were and as they are."""
    mark = F.sha2(F.coalesce("text", F.lit("")), 256)
    same = before.select(key, mark.alias("mark")).join(after.select(key, mark.alias("mark")), [key, "mark"]).select(key)
    return before.join(same, key, "left_anti"), after.join(same, key, "left_anti")
