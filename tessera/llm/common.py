"""Helpers that the training-data operators share: the shared folder, written tables and distributed ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words in every operator: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Tables written by `stash` that are still there, by the application that wrote them.
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master (tests) uses the
    temporary folder; on a cluster a machine's own folder would lose tables, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tessera-shared"
    return base.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"


#: Rows of a narrow table that make one file of some megabytes, and the least number of files.
NARROW_ROWS, LEAST_FILES = 250_000, 16


def stash(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors. The table stays
    until `sweep`. rows: for a narrow table, about how many rows it has at most; it is then written in files of some
    megabytes, however many partitions the shuffle before it has."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    fewer = df if rows is None else df.coalesce(max(LEAST_FILES, -(-rows // NARROW_ROWS)))
    fewer.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def stashed(spark: SparkSession) -> int:
    """How many tables are there: a mark for `sweep`."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def sweep(spark: SparkSession, since: int = 0, keep_last: bool = False) -> None:
    """Delete the tables that `stash` has written after the mark `since`, but the last one if keep_last. For use when
    nothing reads them any more: the results that were made from them are written or collected."""
    paths = _written.get(spark.sparkContext.applicationId, [])
    gone = paths[since : len(paths) - keep_last]
    for path in gone:  # through the file system that wrote them, whatever it is
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths[since : since + len(gone)] = []


def blocks_for(n_rows: int, n_groups: int, rows_per_block: int) -> int:
    """How many hash blocks a group is cut into so that even a group with every row keeps small blocks."""
    return max(16, -(-n_rows // rows_per_block), -(-256 // max(1, n_groups)))


def gapless_rank(df: DataFrame, group: list[str], order: list[str], out: str, blocks: int) -> DataFrame:
    """Number the rows of each group from 0 without gaps, never holding a group in one task.

    Rows are cut into hash blocks of (order columns); a block's offset is the running sum of the counts of the
    blocks before it, and only a block is sorted in one task. The order is by (block, order columns), fixed by the
    data alone. The counts are one row per group and block.
    """
    cut = df.withColumn("__block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    keys = [*group, "__block"]
    before = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        cut.join(offsets, keys)
        .withColumn(out, (F.col("__before") + F.row_number().over(inside) - 1).cast("long"))
        .drop("__block", "__before")
    )


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows as one struct `row` beside working columns, so that no column of the input can clash with them; undo
    with select("row.*")."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])
