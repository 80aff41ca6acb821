"""All queries of the library itself, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    """A query, and the SQL for its rows where SQL can express it."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


_ALL: dict[str, Query] = {}


def register(name: str, sql: str | None = None) -> Callable:
    """Decorator: registers f(spark, sf_dir) under the name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in _ALL:
            raise ValueError(f"{name} is registered twice")
        _ALL[name] = Query(f, sql)
        return f

    return add


def _load() -> None:
    """The modules register their queries when they are first imported."""
    for name in ("text_queries", "url_queries", "html_queries", "page_queries", "job_queries"):
        import_module(f"{__package__}.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: q.run for k, q in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: q.sql for k, q in _ALL.items() if q.sql}
