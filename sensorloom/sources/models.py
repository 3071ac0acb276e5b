"""Stored pipelines and their registry."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.schema import MIN_MODEL_FEATURES

REGISTRY_SCHEMA = "model_id string, n_features int, classifier string, saved_at timestamp"


def model_path(root: str, model_id: str) -> str:
    return f"{root.rstrip('/')}/models/{model_id}"


def save(model: PipelineModel, root: str, model_id: str, n_features: int, classifier: str) -> str:
    """Store a fitted pipeline and add its registry row."""
    path = model_path(root, model_id)
    model.write().overwrite().save(path)
    spark = SparkSession.active()
    row = spark.createDataFrame([(model_id, n_features, classifier, None)], REGISTRY_SCHEMA)
    row.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(f"{root.rstrip('/')}/registry")
    return path


def load(root: str, model_id: str) -> PipelineModel:
    return PipelineModel.load(model_path(root, model_id))


def registry(spark: SparkSession, root: str) -> DataFrame:
    """Latest row per model id that has not been invalidated."""
    from sensorloom.operators.align import latest

    rows = spark.read.schema(REGISTRY_SCHEMA).parquet(f"{root.rstrip('/')}/registry")
    return latest(rows, ["model_id"], [F.col("saved_at").desc()]).where("n_features > 0")


def invalidate(spark: SparkSession, root: str, model_id: str) -> None:
    """A tombstone row hides the model from the registry."""
    row = spark.createDataFrame([(model_id, 0, "", None)], REGISTRY_SCHEMA)
    row.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(f"{root.rstrip('/')}/registry")


def fresh_models(models: DataFrame, min_features: int = MIN_MODEL_FEATURES) -> DataFrame:
    """Models with too few inputs are stale."""
    return models.where(F.col("n_features") >= min_features)
