"""Generic table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Parquet scan of just ``columns`` (all when none are named)."""
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table
