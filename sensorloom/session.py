"""Session-level helpers: size checks, shared folders, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A key group up to this many (estimated) bytes is safe to sort in one task.
SINGLE_TASK_BYTES = 256 * 1024 * 1024


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan. It runs no job; it is derived from file sizes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def split_count(df: DataFrame, target_bytes: int | None = None, most: int = 4096) -> int:
    """How many pieces keep a piece of ``df`` below ``target_bytes`` even if one key owns it all."""
    target = SINGLE_TASK_BYTES if target_bytes is None else target_bytes
    return max(1, min(most, -(-plan_bytes(df) // max(1, target))))


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash-partition for a Python group job. Adaptive execution merges small partitions by bytes,
    but such a job costs time per row, so an explicit number keeps all tasks busy."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def is_local(master: str) -> bool:
    """Do driver and executors run in one process? A local cluster has several."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not is_local(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sensorloom-")  # one machine: its own folder is shared
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, kind: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, kind)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
