"""Technique lists: JSON arrays of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators.unnest import unnest


def parse_techniques(rows: DataFrame, json_column: str, *keys: str) -> DataFrame:
    """One row per name with its place in the list; ``keys`` are kept."""
    names = F.from_json(F.col(json_column), "array<string>")
    return unnest(rows, names, *keys, pos="pos", value="technique")


def read_techniques(spark: SparkSession, path: str) -> DataFrame:
    return parse_techniques(spark.read.text(path, wholetext=True), "value")


def technique_names(spark: SparkSession, path: str) -> list[str]:
    """The list in file order. It is a hand-written file, so it is small."""
    return [row.technique
            for row in read_techniques(spark, path).orderBy("pos").collect()]
