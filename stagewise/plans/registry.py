"""Where queries over the test tables and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def literal(x) -> str:
    """A value in SQL."""
    if x is None:
        return "NULL"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]"
    return str(x).upper() if isinstance(x, bool) else repr(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def values(columns: str, rows) -> str:
    """SQL of a table of rows."""
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") v({columns}))"
