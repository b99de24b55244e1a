"""A table in hash buckets with an atomic manifest: upserts rewrite the buckets that they touch, and nothing else."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_PREFIX = "manifest-"


class Conflict(Exception):
    """Another commit was faster."""


class UnknownIds(ValueError):
    """Rows were to be changed that the table does not have."""


class Files:
    """The few calls of the file system of a path that commits need, whatever system it is."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        at = self._at("")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self._at(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> bool:
        """Whether `old` became `new`; an existing `new` is never replaced."""
        return not self.fs.exists(self._at(new)) and bool(self.fs.rename(self._at(old), self._at(new)))

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


def commit(files: Files, version: int, content: dict) -> None:
    """Publish a manifest as the given version: written aside, then renamed. A write that is torn leaves a draft that no reader looks
    at; a version that is already there is a Conflict."""
    draft = f".draft-{uuid.uuid4().hex}"
    files.write(draft, json.dumps(content, sort_keys=True))
    if not files.rename(draft, f"{_PREFIX}{version:012d}.json"):
        files.delete(draft)
        raise Conflict(f"version {version} of {files.path} is already there")


def latest(files: Files) -> tuple[int, dict]:
    """(version, manifest) of the newest commit; (0, {}) before the first."""
    versions = [n for n in files.names() if n.startswith(_PREFIX) and n.endswith(".json")]
    return (int(versions[-1][len(_PREFIX) : -5]), json.loads(files.read(versions[-1]))) if versions else (0, {})


class SnapshotTable:
    """Rows by a key, in `buckets` hash buckets below a folder. A manifest maps each bucket to the commit that wrote it, so that every
    version stays readable and a reader sees a commit whole or not at all."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.files = Files(spark, self.path)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """(commit, buckets) after writing rows aside, one folder a bucket; a large bucket is written by as many tasks as it needs."""
        name = f"data-{uuid.uuid4().hex}"
        rows.withColumn("__bucket", self._bucket()).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{name}")
        below = Files(self.spark, f"{self.path}/{name}")
        return name, [int(n.partition("=")[2]) for n in below.names() if n.startswith("__bucket=")]

    def create(self, rows: DataFrame) -> int:
        """The first version: all rows."""
        name, found = self._write(rows)
        commit(self.files, 1, {"schema": rows.schema.jsonValue(), "buckets": {str(b): name for b in found}})
        return 1

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version (the newest if not given), or those of some buckets."""
        manifest = latest(self.files)[1] if version is None else json.loads(self.files.read(f"{_PREFIX}{version:012d}.json"))
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/{name}/__bucket={b}" for b, name in sorted(manifest["buckets"].items()) if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def upsert(self, rows: DataFrame, deleted: DataFrame | None = None, only_known: bool = False) -> tuple[int, list[int]]:
        """(version, rewritten buckets) after rows (distinct keys, the table's columns) replace or join those with their keys, and the keys of `deleted`
        go. Only buckets with such keys are read and written, in one commit. only_known: an id that the table does not have is refused,
        and nothing changes."""
        version, manifest = latest(self.files)
        gone = rows.select(self.key) if deleted is None else rows.select(self.key).unionByName(deleted.select(self.key))
        touched = sorted(r[0] for r in gone.select(self._bucket()).distinct().collect())  # as many as there are buckets, at most
        held = self.read(version, touched)
        if only_known:
            unknown = [r[0] for r in gone.join(held, self.key, "left_anti").limit(5).collect()]
            if unknown:
                raise UnknownIds(f"not in {self.path}: {', '.join(map(str, unknown))}")
        kept = held.join(gone.distinct(), self.key, "left_anti").select(*held.columns)
        name, found = self._write(kept.unionByName(rows.select(*held.columns)))
        buckets = {b: n for b, n in manifest["buckets"].items() if int(b) not in touched} | {str(b): name for b in found}
        commit(self.files, version + 1, manifest | {"buckets": buckets})
        return version + 1, touched
