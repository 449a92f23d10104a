"""Stored models: the table of linear models and fitted forests."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

#: Columns of a stored table of linear models.
LINEAR = "species string, features string, c0 double, c_height double, c_crown double"


def save_linear(models: DataFrame, path: str) -> None:
    """Writes (species, features, coefficients) as one parquet folder, replacing an older one."""
    models.select("species", "features", "c0", "c_height", "c_crown").write.mode("overwrite").parquet(path)


def load_linear(spark: SparkSession, path: str) -> DataFrame:
    """The stored linear models under their declared schema."""
    return spark.read.schema(LINEAR).parquet(path)


def save_forest(model: PipelineModel, folder: str, name: str) -> str:
    """Stores a fitted model as ``folder/name``, replacing an older one."""
    path = f"{folder}/{name}"
    model.write().overwrite().save(path)
    return path


def load_forest(path: str) -> PipelineModel:
    return PipelineModel.load(path)
