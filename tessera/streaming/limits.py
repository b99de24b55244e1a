"""Event-time streams: daily counts with a watermark, and the sliding limiter as stateful processing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import shared_folder


def event_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """A parquet table as a stream; its clock is cast to a timestamp, since watermarks need one."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_files(folder, name))
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _files(folder: str, name: str) -> str:
    """A stream reads folders: a table that is one file is named by a pattern."""
    return f"{folder}/{name}.parque[t]"


def daily_counts(events: DataFrame, group: str, lateness: str = "1 day") -> DataFrame:
    """Events of each UTC day and group; rows later than the watermark are dropped."""
    w = events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), group)
    return w.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.to_date("window.start").alias("day"), group, "n", "total")


def limited(events: DataFrame, key: str, tie: str, limit: int, seconds: int) -> DataFrame:
    """The sliding limiter over a stream: the state of a key is its last allowed times, at most `limit` of them.

    Rows of a micro-batch are taken in event-time order; a row older than the state's last time is judged by the
    state as it is. Returns key, tie and allowed.
    """
    width = pd.Timedelta(seconds=seconds)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values(["ts", tie])
        hits = [pd.Timestamp(t) for t in state.get[0]] if state.exists else []
        allowed = []
        for t in rows["ts"]:
            hits = [h for h in hits if h >= t - width]
            allowed.append(len(hits) < limit)
            if allowed[-1]:
                hits.append(t)
        state.update(([h.isoformat() for h in hits],))
        yield pd.DataFrame({key: k[0], tie: rows[tie].to_numpy(), "allowed": allowed})

    kinds = dict(events.dtypes)
    out = f"{key} {kinds[key]}, {tie} {kinds[tie]}, allowed boolean"
    return events.groupBy(key).applyInPandasWithState(step, out, "hits array<string>", "append", "NoTimeout")


def run_once(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process all that is there, into a parquet table in the shared folder, and read it."""
    spark = stream.sparkSession
    path = shared_folder(spark, label)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").outputMode("append").trigger(availableNow=True).start()
    else:
        def keep(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/out")

        q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/log").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(f"{path}/out")
