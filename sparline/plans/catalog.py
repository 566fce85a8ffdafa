"""A registry of queries with, where SQL can express them, their DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = f
            if oracle is not None:
                self.oracles[name] = oracle
            return f

        return add

    def sql(self, name: str, text: str, oracle: str | None = None, tables: tuple[str, ...] = ()) -> None:
        """Register a query that is plain Spark SQL over ``tables``; the oracle is the same text unless given."""

        def run(spark: SparkSession, directory: str) -> DataFrame:
            from sparline.sources.parquet import table

            return spark.sql(text, **{t: table(spark, directory, t) for t in tables})

        self.query(name, oracle)(run)
