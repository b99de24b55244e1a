"""Tables that are stated once and used by Spark and by the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.tables import table


def _literal(value, duck: bool) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        inside = ", ".join(_literal(v, duck) for v in value)
        return f"[{inside}]" if duck else f"array({inside})"
    text = str(value).replace("'", "''") if duck else str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


class Fixture:
    """Rows with named, typed columns. Types are Spark's: int, bigint, double, string, boolean, date, array<...>."""

    def __init__(self, columns: str, rows: Sequence[tuple]):
        self.columns = [tuple(c.strip().split(" ", 1)) for c in columns.split(",")]
        self.rows = rows

    def spark(self, spark: SparkSession, d: str = "") -> DataFrame:
        body = ", ".join("(" + ", ".join(_literal(v, False) for v in r) + ")" for r in self.rows)
        casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in self.columns)
        return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({', '.join(n for n, _ in self.columns)})")

    def duck(self) -> str:
        """The same rows as a subquery for DuckDB."""
        kinds = {"string": "VARCHAR", "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]", "array<double>": "DOUBLE[]"}
        body = ", ".join("(" + ", ".join(_literal(v, True) for v in r) + ")" for r in self.rows)
        casts = ", ".join(f"CAST({n} AS {kinds.get(t, t)}) AS {n}" for n, t in self.columns)
        return f"(SELECT {casts} FROM (VALUES {body}) t({', '.join(n for n, _ in self.columns)}))"


class Made:
    """Rows made from the tables by one SQL text that both engines run. In it, {name} is a table, LIST(x BY y) collects the
    values of x in order of y, and LISTN leaves out nulls."""

    def __init__(self, sql: str):
        self.sql = sql
        self.tables = sorted(set(re.findall(r"\{(\w+)\}", sql)))

    def spark(self, spark: SparkSession, d: str) -> DataFrame:
        def collect(m: re.Match) -> str:
            values = f"transform(array_sort(collect_list(named_struct('o', {m[3]}, 'x', {m[2]}))), s -> s.x)"
            return f"filter({values}, v -> v IS NOT NULL)" if m[1] else values

        return spark.sql(_LIST.sub(collect, self.sql), **{t: table(spark, d, t) for t in self.tables})

    def duck(self) -> str:
        def collect(m: re.Match) -> str:
            values = f"list({m[2]} ORDER BY {m[3]})"
            return f"list_filter({values}, lambda v: v IS NOT NULL)" if m[1] else values

        return f"({_LIST.sub(collect, self.sql).replace(' array(', ' list_value(').format(**{t: t for t in self.tables})})"


_LIST = re.compile(r"LIST(N?)\((.+?) BY (.+?)\)\s")

#: The lines of each order numbered by k, since line numbers may repeat.
NUMBERED = """(SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS INT) AS k FROM {lineitem}) numbered"""
