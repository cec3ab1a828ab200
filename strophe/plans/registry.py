"""Registration of queries with the SQL that states the same result."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: The recordings, each once.
REC = "(SELECT DISTINCT * FROM recordings)"


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def fitted_on(source: str, schema: str) -> Callable[[Query], Query]:
    """For a query that fits something on a table: where that table is empty there is nothing to fit, and the result is empty."""

    def wrap(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, d: str) -> DataFrame:
            if table(spark, d, source).isEmpty():
                return spark.createDataFrame([], schema)
            return f(spark, d)

        return run

    return wrap


def sql_present(c: str) -> str:
    return f"(CASE WHEN {c} IS NOT NULL AND {c} NOT IN ('', 'NA', 'nan', 'None') THEN {c} END)"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def recordings(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Recordings without repeated rows: item_id and the given columns only, so the scan is pruned."""
    return table(spark, d, "recordings").select("item_id", *columns).distinct()
