"""Registry of runnable queries, each next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from pairbench.session import tune
from pairbench.workload.checks import with_tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: Sequence[str] = ()):
    """Register a query; ``sql`` may use the derived ``tables`` of ``checks``."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(tune(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = with_tables(tables, sql)
        return function

    return register
