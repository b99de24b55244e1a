"""Evaluation of set-ups and test sets: configurations as data, graded relevance, excerpts within a budget, verdicts that pass to translations."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.operators.sizes import joined_as, small
from tessera.sources.shared import written

# --- configurations -------------------------------------------------------------------------------------------------


def run_setups(setups: DataFrame, lists: DataFrame, scores: DataFrame, query_key: str, doc_key: str, constant: int = 60) -> DataFrame:
    """setup, query_key, doc_key, rank: the ranking of every set-up, from ranked lists that all of them share.

    setups: setup, lists (array of list names), candidates, rerank (null: none, else the kind of score); lists: list, query_key, doc_key, rank;
    scores: kind, query_key, doc_key, score. A set-up fuses its lists by reciprocal rank, keeps its best candidates, and
    orders them by its score if it has one, equal ones as they were fused. A set-up more is a row more: no list is made for it again."""
    uses = setups.select("setup", "candidates", "rerank", F.posexplode("lists").alias("at", "list"))  # kept by hand
    placed = lists.join(F.broadcast(uses), "list")
    fused = placed.groupBy("setup", "candidates", "rerank", query_key, doc_key).agg(F.round(F.sum(1 / (constant + F.col("rank"))), 9).alias("fused"), F.min(F.struct("at", "rank")).alias("first"))
    order = F.row_number().over(Window.partitionBy("setup", query_key).orderBy(F.desc("fused"), "first", doc_key))
    best = fused.withColumn("place", order).filter(F.col("place") <= F.col("candidates"))
    scored = best.join(scores.select(F.col("kind").alias("rerank"), query_key, doc_key, "score"), ["rerank", query_key, doc_key], "left")
    rank = F.row_number().over(Window.partitionBy("setup", query_key).orderBy(F.coalesce("score", F.lit(0.0)).desc(), "place"))
    return scored.select("setup", query_key, doc_key, rank.alias("rank"))


def graded_metrics(ranked: DataFrame, relevant: DataFrame, by: list[str], query_key: str, doc_key: str, k: int = 5, mrr: int = 10) -> DataFrame:
    """by, query_key, hit, recall, rr of every question with gold documents: gold and acceptable ones count for hit and reciprocal
    rank, gold ones alone for recall. relevant: query_key, doc_key, gold (boolean); ranked: by, query_key, doc_key, rank. A question whose ranking is empty
    scores zero."""
    graded = relevant.groupBy(query_key, doc_key).agg(F.max("gold").alias("gold"))
    asked = graded.groupBy(query_key).agg(F.sum(F.col("gold").cast("int")).alias("n_gold")).filter("n_gold > 0")
    every = ranked.select(*by).distinct().crossJoin(small(asked)) if by else asked
    found = ranked.join(graded, [query_key, doc_key]).groupBy(*by, query_key).agg(
        F.max((F.col("rank") <= k).cast("double")).alias("hit"), F.count(F.when(F.col("gold") & (F.col("rank") <= k), 1)).alias("n_found"), F.min(F.when(F.col("rank") <= mrr, F.col("rank"))).alias("first"))
    return every.join(found, [*by, query_key], "left").select(*by, query_key, F.coalesce("hit", F.lit(0.0)).alias("hit"), (F.coalesce("n_found", F.lit(0)) / F.col("n_gold")).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def summary_by_group(rows: DataFrame, by: list[str], group: str, values: list[str], digits: int = 4) -> DataFrame:
    """by, group, means of the values, n: of each group and, as `all`, of all rows."""
    part = rows.withColumn(group, F.explode(F.array(F.col(group), F.lit("all"))))
    return part.groupBy(*by, group).agg(*[F.round(F.avg(v), digits).alias(v) for v in values], F.count(F.lit(1)).alias("n"))


# --- excerpts -------------------------------------------------------------------------------------------------------


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0)))


def pair_set(text: Column) -> Column:
    """Neighbouring words, one of which has four letters or more."""
    w = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    pairs = F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull() & p.rlike("[a-z]{4,}") & F.contains(p, F.lit(" "))))


@F.pandas_udf(StructType([StructField("pairs", IntegerType()), StructField("words", IntegerType())]))
def shared_counts(pairs: pd.Series, words: pd.Series, lowered: pd.Series) -> pd.DataFrame:
    """How many of some pairs and of some words a text in small letters holds. The texts of a section come again for its next item."""
    @lru_cache(maxsize=16)
    def held(text: str | None) -> tuple[set, set]:
        own = re.findall("[a-z]+", text or "")
        return set(own), set(zip(own, own[1:]))

    def count(p, w, text: str | None) -> tuple[int, int]:
        words, follow = held(text)
        return sum(tuple(x.split(" ")) in follow for x in p), sum(x in words for x in w)

    return pd.DataFrame([count(*x) for x in zip(pairs, words, lowered, strict=True)], columns=["pairs", "words"])


def gold_excerpts(items: DataFrame, chunks: DataFrame, item: str, budget: int) -> DataFrame:
    """item, chunk_id, place (from 1, in document order): the chunks of an item's gold sections that a judge reads.

    All of them if they fit the budget. Else they are ranked by the pairs of neighbouring words, then by the words, that they share with the item's text; the
    best chunk of every gold section is taken whatever its size, then in rank order each that still fits. items: item, text, gold (sections in order, distinct);
    chunks: section_id, ord, chunk_id, text, n_tokens. A section's chunks are few by nature, as is an item's list."""
    # a text meets the items of its section once, and only counts go on
    wanted = items.select(item, pair_set(F.col("text")).alias("asked_pairs"), word_set(F.col("text")).alias("asked_words"), F.posexplode("gold").alias("g", "section_id"))
    held = chunks.select("section_id", "ord", "chunk_id", "n_tokens", F.lower("text").alias("lowered"))
    rows = wanted.join(held, "section_id").select(item, "g", "ord", "chunk_id", "n_tokens", shared_counts("asked_pairs", "asked_words", "lowered").alias("shared")).select("*", "shared.pairs", "shared.words").drop("shared")
    rows = rows.withColumn("total", F.sum("n_tokens").over(Window.partitionBy(item)))
    ranked = rows.select(item, "g", "ord", "chunk_id", F.col("n_tokens").cast("long").alias("t"), "total", F.struct((-F.col("pairs")).alias("p"), (-F.col("words")).alias("w"), "g", "ord", "chunk_id").alias("at"))
    ranked = ranked.withColumn("best", F.row_number().over(Window.partitionBy(item, "g").orderBy("at")) == 1)
    used = F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).over(Window.partitionBy(item))
    lists = ranked.withColumn("used", used).groupBy(item, "total", "used").agg(F.array_sort(F.collect_list(F.struct("at", "t", "best", "g", "ord", "chunk_id"))).alias("c"))
    start = F.struct(F.col("used").alias("size"), F.array().cast("array<boolean>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        more = ~x["best"] & (acc["size"] + x["t"] <= budget)
        return F.struct(F.when(more, acc["size"] + x["t"]).otherwise(acc["size"]).alias("size"), F.concat(acc["kept"], F.array(x["best"] | more)).alias("kept"))

    kept = F.when(F.col("total") <= budget, F.transform("c", lambda x: F.lit(True))).otherwise(F.aggregate("c", start, step, lambda acc: acc["kept"]))
    each = lists.select(item, F.explode(F.arrays_zip(F.col("c.g").alias("g"), F.col("c.ord").alias("ord"), F.col("c.chunk_id").alias("chunk_id"), kept.alias("kept"))).alias("x")).filter("x.kept")
    place = F.row_number().over(Window.partitionBy(item).orderBy("x.g", "x.ord", "x.chunk_id"))
    return each.select(item, "x.chunk_id", place.alias("place"))


# --- verdicts -------------------------------------------------------------------------------------------------------


def inherited_verdicts(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """id, ok, reasons, second_opinion, inherited_from (null for items that were judged) of all items.

    An item with a source has its source's verdict, over chains of any length, and must be worded well itself; what is wrong is said
    in its reasons. A second opinion is passed on and blocks nothing. Chains are followed by pointer jumping, each round twice as far. A round ends all
    items whose chain is less than twice as long as what was ended before, so when it ends none, what is left goes in a circle, and is reported so. Ids are
    distinct. items: id, source_id, language_ok; verdicts: id, ok, reasons, second_opinion."""
    known = items.select("id", "source_id", F.coalesce("language_ok", F.lit(False)).alias("worded"))
    has, sent = F.col("source_id").isNotNull(), joined_as(known)
    rows = known.join(joined_as(verdicts)(verdicts), "id", "left")
    # to: where the chain goes on; own: the item itself is well; rest: all items after this one and before `to` are; absent: its source is not there
    state = written(rows.select("id", F.col("source_id").alias("to"), F.when(has, F.col("worded")).otherwise(F.coalesce("ok", F.lit(False))).alias("own"), F.lit(True).alias("rest"), F.lit(False).alias("absent"), F.when(~has, F.col("second_opinion")).alias("second"), F.lit(False).alias("ended")), "chains")
    first = True
    while True:
        ends = state.select(F.col("id").alias("to"), F.col("to").alias("next"), (F.col("own") & F.col("rest")).alias("well"), F.col("second").alias("theirs"))
        gone = F.col("well").isNull()  # `to` is not there
        moved = state.filter("to IS NOT NULL").join(sent(ends), "to", "left").select("id", F.col("next").alias("to"), "own", (F.col("rest") & F.coalesce("well", F.lit(False))).alias("rest"), (gone if first else F.col("absent")).alias("absent"), F.coalesce("second", "theirs").alias("second"), F.col("next").isNull().alias("ended"))
        state, first = written(moved.unionByName(state.filter("to IS NULL").withColumn("ended", F.lit(False))), "chains"), False
        some_ended, some_left = state.agg(F.max("ended"), F.max(F.col("to").isNotNull())).first()
        if not (some_ended and some_left):
            break
    every = rows.join(sent(state.select("id", "own", "rest", "absent", "second", F.col("to").isNotNull().alias("circle"))), "id")
    why = F.array_compact(F.array(
        F.when(F.col("circle"), F.lit("source questions go in a circle")).when(F.col("absent"), F.concat(F.lit("source question "), "source_id", F.lit(" not verified"))).when(~F.col("rest"), F.concat(F.lit("source question "), "source_id", F.lit(" is flagged"))),
        F.when(~F.col("worded"), F.lit("translation wording not checked by a native speaker yet")),
    ))
    reasons = F.when(has, why).when(F.col("ok").isNull(), F.array(F.lit("not verified"))).otherwise(F.coalesce("reasons", F.array().cast("array<string>")))
    return every.select("id", (F.col("own") & F.col("rest") & ~F.col("circle")).alias("ok"), reasons.alias("reasons"), F.when(~F.col("circle"), F.col("second")).alias("second_opinion"), F.col("source_id").alias("inherited_from"))
