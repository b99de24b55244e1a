"""Checks of a table's size before it is broadcast."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table of at most this many rows may be broadcast.
FEW_ROWS = 100_000


def few(df: DataFrame, most_rows: int = FEW_ROWS) -> bool:
    """Whether a table has at most `most_rows` rows; no more than those are counted."""
    return df.limit(most_rows + 1).count() <= most_rows


def small(df: DataFrame, most_rows: int = FEW_ROWS) -> DataFrame:
    """The table with a broadcast hint if it has at most `most_rows` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if few(df, most_rows) else df


def joined_as(df: DataFrame, most_rows: int = FEW_ROWS) -> Callable[[DataFrame], DataFrame]:
    """The hint for tables with no more rows than `df`: broadcast if those are few, else a shuffled join, even where files are so small that Spark would
    collect the table in the driver by itself."""
    return F.broadcast if few(df, most_rows) else lambda other: other.hint("merge")
