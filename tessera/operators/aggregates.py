"""Summaries: dense matrices, nearest-rank percentiles, weighted modes, allocation and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sizes import small
from tessera.sources.shared import written


def nearest_rank(rows: DataFrame, group: str, value: str, qs: dict[str, float], buckets: int = 128) -> DataFrame:
    """The value at place round(q (n-1)) of each group, halves rounded to even; nulls are left out.

    Equal values are counted first, in each task. A group's distinct values are cut at approximate quantiles, so that every
    bucket holds about as many of them, wherever an outlier lies; the buckets' counts tell where each place lies, and only the values of the
    buckets that are hit are put in order, each bucket by itself. The quantiles are written, since they depend on the order in which executors' parts
    arrive: counted and looked up in buckets that were cut anew, a place would lie elsewhere.
    """
    counts = written(rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n")), "counts")
    at = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    ends = written(counts.groupBy(group).agg(F.percentile_approx(value, at, 10 * buckets).alias("bounds"), F.sum("n").alias("all")), "ends")
    dealt = counts.join(small(ends), group).withColumn("bucket", F.size(F.filter("bounds", lambda b: b < F.col(value)))).drop("bounds")
    sums = dealt.groupBy(group, "all", "bucket").agg(F.sum("n").alias("m"))
    upto = F.sum("m").over(Window.partitionBy(group).orderBy("bucket"))
    places = F.array(*[F.bround(F.lit(q) * (F.col("all") - 1)).cast("long") for q in qs.values()])
    hit = sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("m")).withColumn("places", places)
    hit = hit.filter(F.exists("places", lambda p: (p >= F.col("before")) & (p < F.col("upto")))).select(group, "bucket", "before", "places")
    inside = F.sum("n").over(Window.partitionBy(group, "bucket").orderBy(value)) + F.col("before")
    placed = dealt.join(small(hit), [group, "bucket"]).withColumn("end", inside).withColumn("begin", F.col("end") - F.col("n"))
    found = [F.max(F.when((F.get("places", F.lit(i)) >= F.col("begin")) & (F.get("places", F.lit(i)) < F.col("end")), F.col(value))).alias(name) for i, name in enumerate(qs)]
    return placed.groupBy(group).agg(*found)


def weighted_mode(rows: DataFrame, by: list[str], value: str, weight: Column) -> DataFrame:
    """The value with the most weight in each group; of equal ones the smallest."""
    sums = rows.groupBy(*by, value).agg(F.sum(weight).alias("weight"))
    return sums.groupBy(*by).agg(F.min_by(value, F.struct((-F.col("weight")).alias("less"), value)).alias(value))


def allocate(groups: DataFrame, group: str, size: str, total: int) -> DataFrame:
    """Proportional shares of `total`: the whole part, at least one, then one more for the largest remainders (ties:
    larger groups, then the name) until the sum reaches the total. It never takes one away."""
    everything = groups.agg(F.sum(size).alias("__all"))
    rows = groups.crossJoin(F.broadcast(everything)).withColumn("__exact", F.col(size) * total / F.col("__all"))
    rows = rows.withColumn("__base", F.greatest(F.floor("__exact"), F.lit(1)))
    left = rows.agg((F.lit(total) - F.sum("__base")).alias("__left"))
    order = Window.orderBy(F.desc(F.round(F.col("__exact") - F.floor("__exact"), 9)), F.desc(size), group)
    rows = rows.crossJoin(F.broadcast(left)).withColumn("__rank", F.row_number().over(order))
    return rows.select(group, size, (F.col("__base") + (F.col("__rank") <= F.col("__left")).cast("long")).cast("long").alias("share"))


def sample_order(key: Column, seed: int) -> Column:
    """A repeatable order by which samples are drawn."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def stratified_sample(rows: DataFrame, group: str, key: str, total: int, seed: int) -> DataFrame:
    """Each group's share of `total` rows, the first in the seeded order."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    shares = allocate(sizes, group, "size", total).select(group, "share")
    place = F.row_number().over(Window.partitionBy(group).orderBy("__order", key))
    # no share exceeds the total, so the first filter bounds each group's rows in every task before the shuffle
    ranked = rows.withColumn("__order", sample_order(F.col(key), seed)).withColumn("place", place).filter(F.col("place") <= total)
    return ranked.join(small(shares), group).filter(F.col("place") <= F.col("share")).drop("__order", "share")


def dense_counts(rows: DataFrame, keys: DataFrame, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """Counts for every key of a small key table, zero where no row has it."""
    sums = rows.groupBy(*by).agg(*[F.count(F.when(c, 1)).alias(n) for n, c in measures.items()])
    return keys.join(sums, by, "left").select(*by, *[F.coalesce(n, F.lit(0)).alias(n) for n in measures])
