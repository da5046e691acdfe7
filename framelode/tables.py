"""The catalogue of input tables under one data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; schema comes from the file footers, columns are pruned by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """``Tables(spark, dir).scenes`` is the scenes table."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._made = spark, sf_dir, {}

    def once(self, name: str, build: Callable[[Tables], DataFrame]) -> DataFrame:
        """``build(self)`` written once, for queries that read a view several times."""
        if name not in self._made:
            self._made[name] = cut_lineage(build(self))
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return table(self.spark, self.dir, name)
