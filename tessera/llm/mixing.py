"""Mixing sources to target weights: hierarchical budgets and seeded epochs, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import packed, stash

#: About how many leaves a tree has at most: for the number of files that their tables are written in, not a limit.
LEAVES = 1_000_000
_UP = (Window.unboundedPreceding, Window.currentRow)


def tokens_of(text: Column) -> Column:
    """Words of a text, the unit of the budgets (null: none)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded_place(seed: int, epoch: Column, key: Column) -> Column:
    """A document's place in an epoch's order: 48 bits of an MD5, as a whole number."""
    mark = F.concat(F.lit(f"{seed}/"), epoch.cast("string"), F.lit("/"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(mark.cast("binary")), 1, 12), 16, 10).cast("long")


def share_out(children: DataFrame, parents: list[str]) -> DataFrame:
    """Give each parent's `budget` to its children (`weight`, `cap`) in proportion to weight, none over its cap.

    What a capped child can't use goes to its siblings in proportion to their weights (water filling). Children in
    order of cap / weight are capped as long as that ratio lies under the level that the rest would get. A parent's
    budget never exceeds the sum of its children's caps, so shortages are met among siblings here and only what a
    whole family lacks has gone to the parent's own siblings one level up.
    """
    family = Window.partitionBy(*parents)
    ordered = family.orderBy("__ratio", "node")
    rows = children.withColumn("__ratio", F.col("cap") / F.col("weight"))
    rows = rows.withColumn("__caps", F.sum("cap").over(ordered.rowsBetween(*_UP)) - F.col("cap"))
    rows = rows.withColumn("__weights", F.sum("weight").over(family) - F.sum("weight").over(ordered.rowsBetween(*_UP)) + F.col("weight"))
    rows = rows.withColumn("__level", (F.col("budget") - F.col("__caps")) / F.col("__weights"))
    rows = rows.withColumn("__full", F.col("__ratio") <= F.col("__level"))
    rows = rows.withColumn("__first", F.max(F.when(~F.col("__full"), F.col("__level"))).over(family))
    got = F.when(F.col("__full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("__first")))
    return rows.withColumn("budget", F.round(got, 3)).drop("__ratio", "__caps", "__weights", "__level", "__full", "__first")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], budget: Column, default_weight: float) -> DataFrame:
    """Budgets of the leaves (levels, `cap`), propagated down the tree one level at a time.

    weights[level][value] is a node's weight among its siblings, default_weight where none is given. A leaf of weight
    0, or below a node of weight 0, gets nothing and is left out of the result, and its words count for no family's
    cap, so that what it could have taken is shared among the others.
    """
    def weight(level: str) -> Column:
        given = weights.get(level) or {}
        pairs = [x for k, v in given.items() for x in (F.lit(k), F.lit(float(v)))]
        return F.coalesce(F.create_map(*pairs)[F.col(level)], F.lit(default_weight)) if pairs else F.lit(default_weight)

    for level in levels:
        leaves = leaves.filter(weight(level) > 0)
    nodes = leaves.agg(F.sum("cap").alias("cap")).select(F.least("cap", budget).cast("double").alias("budget"), F.lit(0).alias("__root"))
    above = ["__root"]
    for depth in range(len(levels)):
        path = levels[: depth + 1]
        own = leaves.withColumn("__root", F.lit(0)).groupBy("__root", *path).agg(F.sum("cap").cast("double").alias("cap"))
        own = own.join(nodes.select(*above, "budget"), above).withColumn("weight", weight(levels[depth])).withColumn("node", F.col(levels[depth]))
        nodes = share_out(own, above).drop("weight", "node", "cap")
        above = ["__root", *path]
    return nodes.drop("__root")


def plan_mix(
    docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, float]], budget_ratio: float, max_epochs: int, seed: int = 17, default_weight: float = 1.0, rows_per_bucket: int = 20_000
) -> tuple[DataFrame, DataFrame]:
    """(narrow rows, leaf plan) for a budget of budget_ratio times the words of all documents.

    The plan has one row a leaf: its supply, budget, full_epochs (each document that often), and the last place
    (cut_place, cut_id) that the next epoch's prefix still takes. A prefix ends before the first document that would
    exceed the budget. Rows that repeat a doc_id have one place and are one unit, taken together or not at all, and so are
    rows without doc_id, whose id is a value like others. Units are summed first; the running sum goes over buckets of places and then only inside
    the bucket where the budget ends, so neither a leaf nor an id with a third of all rows is ever in one task.
    """
    names = list(levels)
    rows = docs.select("doc_id", *[F.coalesce(c.cast("string"), F.lit("")).alias(f"__{n}") for n, c in levels.items()], tokens_of(F.col("text")).alias("n_tokens"))
    rows = stash(rows.select("doc_id", *[F.col(f"__{n}").alias(n) for n in names], "n_tokens"), "mix-rows")
    leaves = stash(rows.groupBy(*names).agg(F.sum("n_tokens").alias("supply"), F.count(F.lit(1)).alias("n_docs")), "mix-leaves", LEAVES)
    total = leaves.agg(F.sum("supply").alias("s"), F.sum("n_docs").alias("n")).first()
    wanted = F.lit(float(total["s"] or 0) * budget_ratio)
    given = leaf_budgets(leaves.withColumn("cap", F.col("supply") * max_epochs), names, weights, wanted, default_weight)
    plan = leaves.join(given, names, "left").withColumn("budget", F.coalesce("budget", F.lit(0.0)))
    plan = plan.withColumn("full_epochs", F.when(F.col("supply") > 0, F.least(F.lit(max_epochs), F.floor(F.col("budget") / F.col("supply")))).otherwise(0).cast("int"))
    plan = stash(plan.withColumn("rest", F.col("budget") - F.col("full_epochs") * F.col("supply")), "mix-plan", LEAVES)

    n_buckets = max(64, -(-int(total["n"] or 0) // rows_per_bucket))
    width = -(-(1 << 48) // n_buckets)
    small = F.broadcast(plan.select(*names, "full_epochs", "rest")) if plan.count() <= 100_000 else plan.select(*names, "full_epochs", "rest")
    placed = rows.join(small, names).withColumn("place", seeded_place(seed, F.col("full_epochs"), F.col("doc_id")))
    placed = placed.withColumn("bucket", F.floor(F.col("place") / width))
    before = Window.partitionBy(*names).orderBy("bucket").rowsBetween(*_UP)
    sums = placed.groupBy(*names, "bucket", "rest").agg(F.sum("n_tokens").alias("t")).withColumn("upto", F.sum("t").over(before))
    ends = sums.filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("t") <= F.col("rest"))).groupBy(*names).agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("t")).alias("base")), "bucket").alias("e")).select(*names, F.col("e.bucket").alias("bucket"), F.col("e.base").alias("base"))
    inside = Window.partitionBy(*names).orderBy("place", "doc_id").rowsBetween(*_UP)
    last = placed.join(F.broadcast(ends) if plan.count() <= 100_000 else ends, [*names, "bucket"])
    units = last.groupBy(*names, "place", "doc_id", "base", "rest").agg(F.sum("n_tokens").alias("n_tokens"))
    edge = units.withColumn("run", F.sum("n_tokens").over(inside) + F.col("base"))
    cuts = edge.filter(F.col("run") <= F.col("rest")).groupBy(*names).agg(F.max(F.struct("place", "doc_id")).alias("cut"))
    ended = ends.select(*names, (F.col("bucket") * width).alias("start"))
    plan = plan.join(ended, names, "left").join(cuts, names, "left").select(
        *names, "supply", "n_docs", "budget", "full_epochs",
        F.when(F.col("start").isNull(), F.lit(1 << 48)).otherwise(F.coalesce("cut.place", "start")).alias("cut_place"), F.col("cut.doc_id").alias("cut_id"), F.col("cut").isNotNull().alias("has_cut"),
    )
    return rows, stash(plan, "mix-cuts", LEAVES)


def epochs_of(rows: DataFrame, plan: DataFrame, names: list[str], max_epochs: int, seed: int = 17) -> DataFrame:
    """Add `epochs`, how often each document is taken, from the leaf plan."""
    joined = rows.join(F.broadcast(plan) if plan.count() <= 100_000 else plan, names)
    place = seeded_place(seed, F.col("full_epochs"), F.col("doc_id"))
    upto = F.col("doc_id").isNull() | F.coalesce(F.col("doc_id") <= F.col("cut_id"), F.lit(False))  # no id comes before all others
    inside = (place < F.col("cut_place")) | ((place == F.col("cut_place")) & F.col("has_cut") & upto)
    more = F.when(F.col("full_epochs") < max_epochs, F.coalesce(inside, F.lit(False)).cast("int")).otherwise(0)
    return joined.withColumn("epochs", F.when(F.col("budget") > 0, F.col("full_epochs") + more).otherwise(F.lit(0)).cast("int"))


#: The tree of the registered query and the pipeline: the source's number says which domain it stands for.
DOMAINS = ("web", "books", "code", "forum")
WEIGHTS = {"domain": {"web": 4.0, "books": 3.0, "code": 2.0, "forum": 1.0}, "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}}


def tree() -> dict[str, Column]:
    number = F.coalesce(F.expr("try_cast(regexp_extract(source, '[0-9]+', 0) AS int)"), F.lit(0))
    return {"domain": F.element_at(F.array(*map(F.lit, DOMAINS)), (number % len(DOMAINS)) + 1), "lang": F.col("lang"), "source": F.col("source")}


def mix_report(docs: DataFrame, budget_ratio: float = 1.0, max_epochs: int = 4) -> DataFrame:
    """One row a document: its leaf, words, the leaf's budget, and how many epochs take it (0: not taken).

    Null levels are a leaf of their own, null texts have no words and
    are taken or not by their place in their leaf's order; a leaf without words is not taken. Repeated rows are
    taken each. Empty tables give empty results.
    """
    rows, plan = plan_mix(docs, tree(), WEIGHTS, budget_ratio, max_epochs)
    names = ["domain", "lang", "source"]
    return epochs_of(rows, plan, names, max_epochs).select("doc_id", *names, "n_tokens", F.col("budget").alias("leaf_budget"), "epochs")


def mix_documents(docs: DataFrame, budget_ratio: float = 0.9, max_epochs: int = 1) -> DataFrame:
    """The documents that the mix takes, each as often as its epochs say, all columns as they were; no text is shuffled."""
    levels = tree()
    names = list(levels)
    _, plan = plan_mix(docs, levels, WEIGHTS, budget_ratio, max_epochs)
    rows = packed(docs, doc_id=F.col("doc_id"), **{n: F.coalesce(c.cast("string"), F.lit("")) for n, c in levels.items()})
    taken = epochs_of(rows, plan, names, max_epochs).filter("epochs > 0")
    if max_epochs > 1:
        taken = taken.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("epochs"))))
    return taken.select("row.*")
