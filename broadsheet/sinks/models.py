"""Saving and loading the technique classifier."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVCModel
from pyspark.sql import SparkSession

from broadsheet.operators.classify import TechniqueModel


def save_model(spark: SparkSession, model: TechniqueModel, path: str) -> None:
    """Features, one folder per machine, and the label table."""
    if model.features is not None:
        model.features.write().overwrite().save(f"{path}/features")
    for i, name in enumerate(model.classes):
        if name in model.machines:
            model.machines[name].write().overwrite().save(f"{path}/machine-{i}")
    rows = [(i, name, model.constants.get(name))
            for i, name in enumerate(model.classes)]
    (spark.createDataFrame(rows, "pos int, label string, constant int")
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/labels"))


def load_model(spark: SparkSession, path: str) -> TechniqueModel:
    """Raises ``FileNotFoundError`` when nothing was saved at ``path``."""
    try:
        rows = spark.read.parquet(f"{path}/labels").orderBy("pos").collect()
    except AnalysisException as error:
        raise FileNotFoundError(path) from error
    classes = [row.label for row in rows]
    constants = {row.label: row.constant for row in rows if row.constant is not None}
    machines = {row.label: LinearSVCModel.load(f"{path}/machine-{row.pos}")
                for row in rows if row.constant is None}
    features = PipelineModel.load(f"{path}/features") if rows else None
    return TechniqueModel(features, classes, machines, constants)
