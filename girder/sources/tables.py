"""The driver's tables, read lazily by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """`Tables(spark, folder).orders` reads `orders.parquet`; columns and filters reach the scan."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")

    def values(self, ddl: str, rows: list[tuple]) -> DataFrame:
        """A dictionary given in code."""
        return self._spark.createDataFrame(rows, ddl)
