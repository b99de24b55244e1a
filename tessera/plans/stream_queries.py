"""Streaming queries, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.ordered_queries import ORACLE as ORDERED
from tessera.plans.registering import Book
from tessera.streaming.limits import daily_counts, event_stream, run_once
from tessera.streaming.state import limited, ordered_store

book = Book()
QUERIES, ORACLE = book.QUERIES, book.ORACLE


@book.query("SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_daily_window(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts of the event stream, all windows."""
    return run_once(daily_counts(event_stream(spark, d), "event_type"), "daily", "complete")


@book.query(ORDERED["stateful_rate_limiter"])
def stream_rate_limiter(spark: SparkSession, d: str) -> DataFrame:
    """The sliding limiter over the event stream, as state with timers."""
    with ordered_store(spark):
        return run_once(limited(event_stream(spark, d), "user_id", "event_id", 2, 86_400), "limits")
