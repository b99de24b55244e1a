"""Sources: parquet tables by folder, JSON lines and CSV with declared schemas, and keyed caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a declared schema; a line that does not fit stops the job, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def checked(rows: DataFrame, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """The rows, stopping the job at a value outside its fixed set (null passes)."""
    for name, values in allowed.items():
        if name in rows.columns:
            rows = rows.withColumn(name, F.when(F.col(name).isNull() | F.col(name).isin(*values), F.col(name)).otherwise(F.raise_error(F.concat(F.lit(f"{name}: "), F.col(name)))))
    return rows


def read_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, footnotes) of pages in JSON lines, one row each. Rows carry their page, y and x: order by them to read."""
    from tessera.schemas import PAGE

    pages = read_json_lines(spark, path, PAGE)
    lines = pages.select(F.explode("lines").alias("l")).select("l.*")
    return lines, pages.select(F.explode("footnotes").alias("f")).select("f.*")


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of terms: lists are split on | (roman lower-cased), section ids on white space, search is yes or not."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)

    def parts(name, pattern=r"\|"):
        return F.filter(F.transform(F.split(F.coalesce(name, F.lit("")), pattern), lambda t: F.trim(t)), lambda t: t != "")

    return rows.select(
        parts(F.lower("roman")).alias("roman"), parts(F.col("urdu")).alias("urdu"), F.trim("english").alias("english"),
        parts(F.col("section_ids"), r"\s+").alias("section_ids"), F.coalesce(F.lower(F.trim("search")) == "yes", F.lit(False)).alias("search"), F.coalesce(F.trim("notes"), F.lit("")).alias("notes"),
    )


def write_snapshot(chunks: DataFrame, path: str) -> None:
    """Chunks by law and version: snapshots lie side by side, and a filter on either prunes folders."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("law", "version_date").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new`, and those of `old` whose keys are not among them."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def last_by_key(log: DataFrame, key: str, order: str) -> DataFrame:
    """An append-only log as a keyed table: the last line of each key."""
    return log.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in log.columns if c != key]), order).alias("row")).select(key, "row.*")


def cached(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(requests with their cached value, requests that the cache doesn't know): only the latter go to a model."""
    return requests.join(cache, key, "left"), requests.join(cache, key, "left_anti")


def newest_report(files: DataFrame) -> DataFrame:
    """Of dated report files (name, path), the newest of each name: the last by file name."""
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("path")))
    return files.withColumn("n", rank).filter("n = 1").drop("n")


def append_log(rows: DataFrame, path: str) -> None:
    """Add rows to a log of asks, by day: `created_at` names the folder."""
    rows.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def write_report(rows: DataFrame, path: str, name: str, date: str) -> str:
    """Rows as one dated report in JSON lines; returns its folder. Reports of other dates stay."""
    folder = f"{path}/{date}-{name}.json"
    rows.write.mode("overwrite").json(folder)
    return folder


def read_reports(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of all dated reports under a folder, with `report`, the report's file name without its end."""
    rows = spark.read.schema(schema).json(f"{path}/*.json")
    return rows.withColumn("report", F.regexp_extract(F.input_file_name(), r"/([^/]+)[.]json/[^/]*$", 1))


def to_fetch(known: DataFrame, offered: DataFrame, key: str) -> DataFrame:
    """key, reason of the files to load: those not known, those whose bytes on disk differ from the manifest, and those whose
    etag, date or length has changed. known: key, sha256, on_disk, etag, modified, length; offered: key, etag, modified, length."""
    facts = ["etag", "modified", "length"]
    both = offered.join(known.select(key, "sha256", "on_disk", *[F.col(f).alias(f"old_{f}") for f in facts]), key, "left")
    same = F.lit(True)
    for f in facts:
        same = same & F.col(f).eqNullSafe(F.col(f"old_{f}"))
    reason = F.when(F.col("sha256").isNull(), "new").when(~F.col("sha256").eqNullSafe(F.col("on_disk")), "damaged").when(~same, "changed")
    return both.select(key, reason.alias("reason")).filter("reason IS NOT NULL")
