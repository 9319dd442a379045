"""All queries of the core, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def stats_sql(k: str, n: str, p: str) -> str:
    """SQL of P(X <= k) for n draws at p, summed in logs."""
    return f"coalesce(list_sum(list_transform(range(0, ({k} + 1)::BIGINT), lambda j: exp(lgamma({n} + 1) - lgamma(j + 1) - lgamma({n} - j + 1) + j * ln({p}) + ({n} - j) * ln(1 - ({p}))))), 0)"
