"""Queries by name: what runs them on Spark, and DuckDB SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None = None


_QUERIES: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Run], Run]:
    """Registers a function (spark, sf_dir) -> DataFrame, with the SQL that an independent engine runs for it."""

    def add(run: Run) -> Run:
        key = name or run.__name__
        if key in _QUERIES:
            raise ValueError(f"two queries are named {key}")
        _QUERIES[key] = Query(run, sql)
        return run

    return add


def _load() -> dict[str, Query]:
    from . import catalog  # noqa: F401  registers

    return _QUERIES


def queries() -> dict[str, Run]:
    return {name: q.run for name, q in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in _load().items() if q.sql}
