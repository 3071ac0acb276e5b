"""Keyed stores on plain Parquet: feature cache, result and comparison documents, history, catalog.

Writes append versions or replace single partitions; reads pick the newest version per key. Nothing
is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions.text import natural_key
from sensorloom.operators import align, history
from sensorloom.schema import COMPARISON_TTL_SECONDS, GENERAL_ID, GENERAL_MANUAL_ID

ID = "subject_id"


def save_features(features: DataFrame, path: str) -> None:
    """Replace exactly the subjects in ``features``."""
    (
        features.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(ID).parquet(path)
    )


def load_features(spark: SparkSession, path: str, subjects: list[str] | None = None, schema=None) -> DataFrame:
    """Cached features; named subjects prune to their partitions."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return df.where(F.col(ID).isin(*subjects)) if subjects else df


# --- Versioned documents -----------------------------------------------------------------------


def document(rows: DataFrame, key: str = ID, version: Column | None = None, cols: list[str] | None = None) -> DataFrame:
    """(key, version, data): each row as one JSON text."""
    body = [F.col(c) for c in (cols or rows.columns)]
    return rows.select(key, (version if version is not None else F.current_timestamp()).alias("version"), F.to_json(F.struct(*body)).alias("data"))


def tombstones(keys: DataFrame, version: Column, key: str = ID) -> DataFrame:
    """A deleted key is a newer version without data."""
    return keys.select(key, version.alias("version"), F.lit(None).cast("string").alias("data"))


def current(versions: DataFrame, key: str = ID) -> DataFrame:
    """Newest live version per key."""
    newest = align.latest(versions, [key], [F.col("version").desc(), F.col("data").desc_nulls_first()])
    return newest.where(F.col("data").isNotNull())


def decode(documents: DataFrame, schema: str, key: str = ID) -> DataFrame:
    kept = [c for c in documents.columns if c != "data"]
    return documents.select(*kept, F.from_json("data", schema).alias("d")).select(*kept, "d.*")


def save_documents(documents: DataFrame, path: str) -> None:
    documents.write.mode("append").parquet(path)


def comparison(versions: DataFrame, now: Column, ttl: int = COMPARISON_TTL_SECONDS, key: str = ID) -> DataFrame:
    """Newest comparison per key and where it may be served from: memory while younger than the
    lifetime, the store afterwards."""
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col("version").cast("timestamp"))
    return current(versions, key).withColumn("served_from", F.when(age <= ttl, "memory").otherwise("store"))


# --- Catalog -----------------------------------------------------------------------------------


def subjects_with_models(models: DataFrame, key: str = ID) -> DataFrame:
    """Distinct model ids without the general ones, in natural order."""
    ids = models.select(key).distinct().where(~F.col(key).isin(GENERAL_ID, GENERAL_MANUAL_ID))
    return ids.withColumn("__k", natural_key(F.col(key))).orderBy("__k").drop("__k")


def saved_files(recordings: DataFrame, models: DataFrame, features: DataFrame, key: str = ID) -> DataFrame:
    return align.with_flags(recordings, key, {"has_model": models, "has_cache": features})


def delete_cascade(doomed: DataFrame, tables: dict[str, DataFrame], key: str = ID) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted keys."""
    gone = doomed.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}


def write_csv(entries: DataFrame, path: str) -> None:
    history.csv_frame(entries).write.mode("errorifexists").option("header", "true").option("escape", '"').csv(path)


def write_results(results: DataFrame, path: str, key: str = ID) -> None:
    """One JSON document per subject, as many files as tasks."""
    results.select(key, F.struct("*").alias("result")).write.mode("errorifexists").json(path)
