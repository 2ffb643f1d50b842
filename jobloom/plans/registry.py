"""All registered queries and their SQL, gathered from the modules of jobloom.plans."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, sf_dir) under its own name, with the SQL that gives the same rows."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)


def _load() -> None:
    """Imports the modules that register queries."""
    for name in ("text_queries", "serving_queries", "state_queries", "source_queries", "stream_queries", "change_queries"):
        importlib.import_module(f"jobloom.plans.{name}")
