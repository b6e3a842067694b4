"""Registry of named queries over the given tables, each with its SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
DIGITS = 6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


def iso(c: str | Column, name: str | None = None) -> Column:
    """A time as text, so that both engines show the same value."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name or str(c))


def rounded(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col.cast("double"), DIGITS) + F.lit(0.0)).alias(name or str(c))


def iso_sql(c: str, name: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {name or c}"


def rounded_sql(c: str, name: str | None = None) -> str:
    return f"round(CAST({c} AS DOUBLE), {DIGITS}) + CAST(0 AS DOUBLE) AS {name or c}"
