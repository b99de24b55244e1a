"""The sliding limiter as arbitrary state with timers: rows wait in order until the watermark has passed them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that are handed on at a time.
BATCH = 1000


class SlidingLimiter(StatefulProcessor):
    """State of a key: `waiting`, its rows by time and tie, which the store keeps in order, and `hits`, its allowed times of the last `width`
    microseconds, `limit` of them at most.

    A row waits until the watermark reaches it, so that rows are judged in the order of their time however they arrive. Neither a batch nor a
    task holds a key's rows in memory: they come, wait and go one after the other. When a key has been quiet for the whole width, a
    timer drops its hits."""

    def __init__(self, limit: int, width: int, key: str, tie: str):
        self.limit, self.width, self.key, self.tie = limit, width, key, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "place string", "tie long")
        self.hits = handle.getValueState("hits", "times array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for b in rows:
            for at, tie in zip(b["at"], b[self.tie], strict=True):
                # both numbers as text of one length, shifted so that none is negative: the order of bytes is that of the numbers
                self.waiting.updateValue((f"{int(at) + (1 << 62):020d}{int(tie) + (1 << 62):020d}",), (int(tie),))
                last = int(at) if last is None else max(last, int(at))
        if last is not None:
            self.handle.registerTimer(last // 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = (expiredTimerInfo.getExpiryTimeInMs() + 1) * 1000
        stored = self.hits.get()
        hits = list(stored[0]) if stored else []
        done: list[tuple[str, int, bool]] = []
        for (place,), (tie,) in self.waiting.iterator():
            at = int(place[:20]) - (1 << 62)
            if at >= now:
                break
            hits = [h for h in hits if h >= at - self.width]
            allowed = len(hits) < self.limit
            if allowed:
                hits.append(at)
            done.append((place, tie, allowed))
            if len(done) == BATCH:
                yield self._out(key, done)
                done = []
        if done:
            yield self._out(key, done)
        hits = [h for h in hits if h >= now - self.width]
        if hits:
            self.hits.update((hits,))
            self.handle.registerTimer((hits[-1] + self.width) // 1000 + 1)
        else:
            self.hits.clear()

    def _out(self, key, done: list[tuple[str, int, bool]]) -> pd.DataFrame:
        for place, _, _ in done:
            self.waiting.removeKey((place,))
        return pd.DataFrame({self.key: [key[0]] * len(done), self.tie: [t for _, t, _ in done], "allowed": [a for *_, a in done]})

    def close(self) -> None:
        pass


@contextmanager
def ordered_store(spark: SparkSession):
    """Streams that start in here keep their state in RocksDB, which is ordered and need not fit in memory."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def limited(events: DataFrame, key: str, tie: str, limit: int, seconds: int, lateness: str = "0 seconds") -> DataFrame:
    """The sliding limiter over a stream with a clock `ts`: key, tie (a whole number that is distinct within a key's instant) and allowed, for each row once the watermark has
    reached it. Fewer than `limit` allowed rows of the key must lie in the `seconds` before (that far included); rows that are turned away
    leave no trace.

    Rows later than the watermark, `lateness` behind the newest row of earlier batches, are dropped; rows within `lateness` of the
    stream's end wait for it to go on. Rows without a time or a key are dropped. Run it within `ordered_store`."""
    rows = events.filter(F.col("ts").isNotNull() & F.col(key).isNotNull()).withWatermark("ts", lateness)
    kinds = dict(events.dtypes)
    out = f"{key} {kinds[key]}, {tie} {kinds[tie]}, allowed boolean"
    return rows.select(key, tie, "ts", F.unix_micros("ts").alias("at")).groupBy(key).transformWithStateInPandas(SlidingLimiter(limit, seconds * 1_000_000, key, tie), out, "append", "eventTime")
