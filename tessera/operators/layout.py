"""From spans on pages to lines and table pieces: geometry as folds over a page, which is small by nature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import estimate_tokens
from tessera.operators.ordered import greedy_groups


def body_spans(spans: DataFrame, page: str, y: str, separator: Column, junk: Column) -> DataFrame:
    """The spans that are no junk and lie over their page's lowest separator of footnotes, by a point at least."""
    lowest = F.max(F.when(separator, F.col(y))).over(Window.partitionBy(page))
    rows = spans.withColumn("__separator", lowest).filter(~junk)
    return rows.filter(F.col("__separator").isNull() | (F.col(y) < F.col("__separator") - 1)).drop("__separator")


def body_lines(lines: DataFrame, top: float, bottom: float, least_size: float, junk_size: float) -> DataFrame:
    """The lines of a page's body: without spans of `junk_size` or larger, without running headers and footers (of `least_size` or larger, above `top` or
    below `bottom`), and without lines of only brackets and punctuation. lines: y, size, text."""
    edge = ((F.col("y") < top) | (F.col("y") > bottom)) & (F.col("size") >= least_size)
    empty = F.regexp_replace("text", r"[\[\].;,*\s]", "") == ""
    return lines.filter((F.col("size") < junk_size) & ~edge & ~empty)


def baselines(spans: DataFrame, page: str, y: str, x: str, text: str, tolerance: float = 3.0) -> DataFrame:
    """page, y, text: spans whose y lies within `tolerance` of the first span of their line, joined from left to right. A
    line is anchored at its first y, so a page that drifts does not run together."""
    found = F.array_sort(F.collect_list(F.struct(F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"), F.col(text).alias("text"))))
    none = F.array().cast("array<struct<y:double,parts:array<struct<x:double,text:string>>>>")

    def step(acc: Column, s: Column) -> Column:
        part, last = F.struct(s["x"].alias("x"), s["text"].alias("text")), F.element_at(acc, -1)
        opens = (F.size(acc) == 0) | (s["y"] - last["y"] > tolerance)
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["y"].alias("y"), F.concat(last["parts"], F.array(part)).alias("parts"))))
        return F.when(opens, F.concat(acc, F.array(F.struct(s["y"].alias("y"), F.array(part).alias("parts"))))).otherwise(longer)

    lines = spans.groupBy(page).agg(F.aggregate(found, none, step).alias("lines")).select(page, F.explode("lines").alias("l"))
    return lines.select(page, F.col("l.y").alias("y"), F.array_join(F.transform(F.array_sort("l.parts"), lambda p: p["text"]), " ").alias("text"))


def page_states(pages: DataFrame, by: list[str], order: str, begins: Column, ends: Column, schedule: Column) -> DataFrame:
    """The pages of a law's body, from the first that begins it to the first that ends it, and after that only pages of
    schedules; `state` says which."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    begun, ended = F.max(begins).over(upto), F.max(ends).over(upto)
    state = F.when(ended, "schedule").when(begun, "body").otherwise("before")
    rows = pages.withColumn("__schedule", schedule).withColumn("state", state)
    return rows.filter((F.col("state") == "body") | ((F.col("state") == "schedule") & F.col("__schedule"))).drop("__schedule")


def split_tables(rows: DataFrame, table: str, order: str, text: str, limit: int) -> DataFrame:
    """table, piece, text: the rows of a table in order, packed into pieces of at most `limit` estimated tokens, each with
    the first row as its header. A row that is too long alone is a piece of its own."""
    lists = rows.groupBy(table).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("text")))).alias("r"))
    lists = lists.select(table, F.col("r")[0]["text"].alias("header"), F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))).alias("r"))
    of = greedy_groups(F.transform("r", lambda x: estimate_tokens(x["text"])), F.lit(limit) - estimate_tokens(F.col("header")))
    each = lists.select(table, "header", F.posexplode(F.arrays_zip(F.col("r.text").alias("text"), of.alias("piece"))).alias("at", "x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("x.text").alias("text")))), lambda p: p["text"]), "\n")
    return each.groupBy(table, "header", F.col("x.piece").alias("piece")).agg(body.alias("body")).select(table, "piece", F.concat("header", F.lit("\n"), "body").alias("text"))


def contents(entries: Column, most_ahead: int = 50) -> Column:
    """The entries (number, title) of a table of contents in order of a text, up to the first whose title begins the schedules; each number goes up
    from the last one accepted, by `most_ahead` at most, so that stray page numbers are passed over."""
    none = F.array().cast("array<struct<number:int,title:string>>")
    begins = F.array_position(F.transform(entries, lambda e: F.coalesce(F.lower(F.trim(e["title"])).rlike("^(?:the )?(?:[a-z]+ )?schedules?$"), F.lit(False))), True)
    live = F.when(begins > 0, F.slice(entries, F.lit(1), (begins - 1).cast("int"))).otherwise(entries)

    def step(acc: Column, e: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.lit(-1))["number"], F.lit(0))
        return F.when((e["number"] > last) & (e["number"] <= last + most_ahead), F.concat(acc, F.array(F.struct(e["number"].alias("number"), e["title"].alias("title"))))).otherwise(acc)

    return F.aggregate(live, none, step)


def listed_numbers(numbers: Column, most_ahead: int = 50) -> Column:
    """The entries of a table of contents in order of a text: each number goes up from the last one accepted, by
    `most_ahead` at most, so that stray page numbers are passed over."""
    none = F.array().cast("array<int>")

    def step(acc: Column, n: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))
        return F.when((n > last) & (n <= last + most_ahead), F.concat(acc, F.array(n))).otherwise(acc)

    return F.aggregate(numbers, none, step)
