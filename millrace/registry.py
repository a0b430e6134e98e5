"""Named queries: a DataFrame function over the tables of a folder, and SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def values(self, schema: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)


def query(sql: str | None = None, name: str | None = None):
    """Register a function of Tables under its name."""

    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            SQL[key] = sql
        return fn

    return add


def load() -> None:
    """Import the modules that register queries."""
    from .operators import comparison, corpus, curation, evaluation, governance, linking, profiling, relational, retrieval, routing, understanding  # noqa: F401
    from .streaming import events  # noqa: F401
