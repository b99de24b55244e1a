"""The decorator that pairs a query with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from tessera.functions.phrases import TOKEN


def duck_line(text: str) -> str:
    """The token line of an SQL expression, for DuckDB."""
    return f"(' ' || array_to_string(regexp_extract_all({text}, '{TOKEN}'), '  ') || ' ')"


def quoted(pattern: str) -> str:
    """A pattern as an SQL string."""
    return "'" + pattern.replace("'", "''") + "'"


class Book:
    """Queries of one module, and their SQL."""

    def __init__(self):
        self.QUERIES: dict[str, Callable] = {}
        self.ORACLE: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def register(f):
            self.QUERIES[f.__name__] = f
            if sql:
                self.ORACLE[f.__name__] = sql
            return f

        return register
