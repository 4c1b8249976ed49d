"""Saved analyses, of this and older generations."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet import constants as C
from broadsheet import schemas


def unify_history(rows: DataFrame) -> DataFrame:
    """One shape for every generation: the owner is ``email``.

    Older rows name the owner in ``username``. Their signed sentiment value
    stays as it was saved.
    """
    owner = F.coalesce(*[F.col(name) for name in ("email", "username")
                         if name in rows.columns], F.lit(C.DEFAULT_OWNER))
    return rows.withColumn("email", owner).drop("username")


def read_history_files(spark: SparkSession, path) -> DataFrame:
    """Import ``*_history.json`` files of any age."""
    rows = (spark.read.schema(schemas.HISTORY_FILE)
            .option("multiLine", True).json(path))
    return unify_history(rows)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The history table; an empty one when nothing was saved yet."""
    try:
        names = [field.name for field in schemas.HISTORY_TABLE.fields]
        return spark.read.schema(schemas.HISTORY_TABLE).parquet(path).select(*names)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.HISTORY_TABLE)
