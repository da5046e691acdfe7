"""Named queries: a callable ``(spark, sf_dir) -> DataFrame`` and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from ..tables import Tables

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Register a function of ``Tables``."""

        def wrap(fn: Callable[[Tables], DataFrame]):
            if name in self.queries:
                raise ValueError(f"two queries are named {name}")

            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship_package(spark)
                return fn(Tables(spark, sf_dir))

            self.queries[name] = run
            if sql:
                self.sql[name] = sql
            return fn

        return wrap

    def merge(self, *others: Registry) -> Registry:
        for o in others:
            both = self.queries.keys() & o.queries.keys()
            if both:
                raise ValueError(f"two queries are named {sorted(both)}")
            self.queries |= o.queries
            self.sql |= o.sql
        return self
