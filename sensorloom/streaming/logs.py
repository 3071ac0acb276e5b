"""Streams into keyed stores. A micro-batch replaces its own partition of an append-only log, so a
replayed batch changes nothing; readers see the newest rows per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators import history
from sensorloom.schema import HISTORY_CAP


def log_writer(path: str, reduce_batch: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function. The batch is cut to what can survive before it is written."""
    def write(batch: DataFrame, batch_id: int) -> None:
        reduce_batch(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def history_writer(path: str, cap: int = HISTORY_CAP, tie: str = "seq") -> Callable[[DataFrame, int], None]:
    return log_writer(path, lambda batch: history.newest(batch, cap, tie=tie))


def read_history(spark: SparkSession, path: str, schema, cap: int = HISTORY_CAP, tie: str = "seq") -> DataFrame:
    """The newest ``cap`` entries per id over all batches; a row sent twice counts once."""
    rows = spark.read.schema(schema).option("basePath", path).parquet(path).drop("batch")
    return history.newest(rows.dropDuplicates([history.ID, history.TIME, tie]), cap, tie=tie)


def compact(spark: SparkSession, path: str, target: str, schema, cap: int = HISTORY_CAP, tie: str = "seq") -> None:
    """Write the current state as the single batch of a new log."""
    read_history(spark, path, schema, cap, tie).write.mode("errorifexists").parquet(f"{target}/batch=0")


def latest_writer(path: str, tie: str = "seq") -> Callable[[DataFrame, int], None]:
    return history_writer(path, 1, tie)


def read_latest(spark: SparkSession, path: str, schema, now: Column, ttl_seconds: int, tie: str = "seq") -> DataFrame:
    """Newest row per id while it is younger than its lifetime."""
    rows = read_history(spark, path, schema, 1, tie)
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col(history.TIME).cast("timestamp"))
    return rows.where(age <= ttl_seconds)
