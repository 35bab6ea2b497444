"""Queries over the test tables, each with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (table reader) -> DataFrame; a table reader takes a table's name."""

    def register(make: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return make

    return register


from . import batches, claims, gold, graphs, reading, rows, runs, scores, streams, texts, validation  # noqa: E402,F401
