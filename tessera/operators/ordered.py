"""Operators over ordered rows: running maxima, fill-down, sessions, folds, bands and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import written


def monotone(rows: DataFrame, by: list[str], order: list[str], key: Column, out: str = "accepted") -> DataFrame:
    """Mark the rows whose key exceeds all keys before it: a heading opens a section only if its number goes up. The
    last accepted key is always the running maximum, so a window is exact."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__key", key).withColumn(out, F.coalesce(F.col("__key") > F.max("__key").over(before), F.lit(True))).drop("__key")


def fill_down(rows: DataFrame, by: list[str], order: list[str], column: str, out: str) -> DataFrame:
    """The last value that is not null, at or before each row."""
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(column, ignorenulls=True).over(upto))


def sessions(rows: DataFrame, by: list[str], order: list[str], starts: Column, out: str = "session") -> DataFrame:
    """Number the runs that begin at rows where `starts` holds (and at the first row). `starts` may look at earlier
    columns made with lag()."""
    w = Window.partitionBy(*by).orderBy(*order)
    first = F.row_number().over(w) == 1
    flagged = rows.withColumn("__start", F.when(first | F.coalesce(starts, F.lit(False)), 1).otherwise(0))
    return flagged.withColumn(out, F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__start")


def joined_in_order(rows: DataFrame, by: list[str], order: str, text: str, out: str, glue: str = " ") -> DataFrame:
    """The texts of each group joined in order. Groups are pages, turns or paragraphs, which are small by nature."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p[text]), glue).alias(out))


def greedy_groups(sizes: Column, limit: int | Column) -> Column:
    """A group number for each size in order: a group is closed before the size that would carry it over the limit.

    Where a group ends depends on where the one before it ended, so this is a fold and no window."""
    start = F.struct(F.array().cast("array<int>").alias("of"), F.lit(0).alias("group"), F.lit(0).cast("long").alias("size"))

    def step(acc, x):
        full = (acc["size"] > 0) & (acc["size"] + x > limit)
        group = F.when(full, acc["group"] + 1).otherwise(acc["group"])
        return F.struct(F.concat(acc["of"], F.array(group)).alias("of"), group.alias("group"), F.when(full, x.cast("long")).otherwise(acc["size"] + x).alias("size"))

    return F.aggregate(sizes, start, step, lambda acc: acc["of"])


def anchored_clusters(values: Column, tolerance: float) -> Column:
    """The first value of each cluster: a value over `tolerance` from its cluster's first value opens a new one (a
    gap to the value before would give other clusters where values drift)."""
    none = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(values), none, lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) > tolerance), F.concat(acc, F.array(x))).otherwise(acc))


def number_chain(numbers: Column) -> Column:
    """The numbers 1, 2, 3 ... as far as each follows the one before somewhere later in the list."""
    none = F.array().cast("array<int>")
    return F.aggregate(numbers, none, lambda acc, n: F.when(n == F.size(acc) + 1, F.concat(acc, F.array(n))).otherwise(acc))


def carried_notes(pages: Column) -> Column:
    """Footnotes of pages in order, each page an array of (marker, text): a page's first note without a marker belongs
    to the last note of the page before, if that page still has one. An empty page stops the carry."""
    kind = "array<array<struct<marker:string,text:string>>>"

    def step(acc, page):
        last = F.element_at(acc, -1)
        carry = (F.size(acc) > 0) & (F.size(page) > 0) & (F.size(last) > 0) & (page[0]["marker"] == "")
        longer = F.struct(F.element_at(last, -1)["marker"].alias("marker"), F.concat(F.element_at(last, -1)["text"], F.lit(" "), page[0]["text"]).alias("text"))
        head = F.slice(acc, 1, F.size(acc) - 1)
        merged = F.concat(F.slice(last, 1, F.size(last) - 1), F.array(longer))
        rest = F.slice(page, 2, F.greatest(F.size(page) - 1, F.lit(0)))
        return F.when(carry, F.concat(head, F.array(merged), F.array(rest))).otherwise(F.concat(acc, F.array(page)))

    return F.aggregate(pages, F.array().cast(kind), step)


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, out: str) -> DataFrame:
    """Each left row with the last right value at or before it in its group: a union in order and a fill-down, so
    both sides are sorted once and no pair is ever made."""
    a = left.withColumn("__right", F.lit(0)).withColumn(out, F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*by, at, F.col(value).alias(out)).withColumn("__right", F.lit(1))
    both = b.unionByName(a, allowMissingColumns=True)
    upto = Window.partitionBy(*by).orderBy(at, F.desc("__right")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last(out, ignorenulls=True).over(upto)).filter("__right = 0").select(*left.columns, out)


def band_join(points: DataFrame, bands: DataFrame, by: list[str], x: str, lo: str, hi: str, width: float | None = None) -> DataFrame:
    """Points with the bands that hold them, lo <= x < hi. With `width`, both sides are cut into buckets of that width
    and joined on them, so a group's points and bands meet only where they are near."""
    inside = (F.col(x) >= F.col(lo)) & (F.col(x) < F.col(hi))
    if width is None:
        return points.join(bands, by).filter(inside)
    p = points.withColumn("__cell", F.floor(F.col(x) / width))
    b = bands.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return p.join(b, [*by, "__cell"]).filter(inside).drop("__cell")


def last_within(points: DataFrame, values: DataFrame, by: list[str], at: str, x: str, below: float, above: float) -> DataFrame:
    """Each point with the largest value of its group in [at - below, at + above], null if there is none.

    The axis is cut into cells as wide as the reach, so a point looks into two or three of them, by one as-of scan in each: no pair is ever
    made, and a task holds a cell of a group, not the group. Points are known by all their columns, equal ones become one."""
    cell = lambda c: F.floor(c / (below + above))
    mine = [F.col(c) for c in points.columns]
    reach = points.distinct().select(*mine, F.explode_outer(F.sequence(cell(F.col(at) - below), cell(F.col(at) + above))).alias("__cell"), (F.col(at) + above).alias("__at"))
    held = values.select(*by, cell(F.col(x)).alias("__cell"), F.col(x).alias("__at"), x).dropna()
    found = as_of(reach, held, [*by, "__cell"], "__at", x, x)
    return found.groupBy(*points.columns).agg(F.max(F.when(F.col(x) >= F.col(at) - below, F.col(x))).alias(x))


def numbered(rows: DataFrame, by: str, out: str = "ord") -> DataFrame:
    """Rows numbered from 0 in the order of the column `by` (distinct values), over all rows and without one task for
    all: ranges of `by` are sorted in tasks, and each range begins where the counts of those before it end."""
    ranges = written(rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part, at = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = ranges.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))  # one row a partition
    return ranges.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(out, F.col("__before") + at).drop("__part", "__before", "__at")
