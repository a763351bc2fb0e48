"""Where query modules enter their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandframe.sources.views import Views, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Enter a function of the views as a query; ``sql`` gives the same rows in DuckDB, views named as they are."""

    def enter(f: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Views(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            SQL[name] = duck(sql)
        return f

    return enter


def also(name: str, of: str) -> None:
    """Enter a query under an earlier name too."""
    QUERIES[name], SQL[name] = QUERIES[of], SQL[of]
