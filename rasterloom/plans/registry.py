"""Registration of queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFunction = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries of one module by name, and the DuckDB SQL of those that SQL can express."""

    def __init__(self) -> None:
        self.functions: dict[str, QueryFunction] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[QueryFunction], QueryFunction]:
        def add(function: QueryFunction) -> QueryFunction:
            self.functions[function.__name__] = function
            if sql:
                self.sql[function.__name__] = sql
            return function

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
