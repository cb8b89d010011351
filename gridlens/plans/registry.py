"""Where query modules enter their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Enter a query (spark, sf_dir) under a name; sql: the same for DuckDB, after the views of fixtures.VIEWS that it names."""

    def enter(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            from .fixtures import with_views

            ORACLE_SQL[name] = with_views(sql)
        return f

    return enter
