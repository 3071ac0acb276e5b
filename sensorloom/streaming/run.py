"""Start file streams and drain them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sensorloom.session import shared_dir


def read_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream one Parquet table of a folder. The schema comes from the stored file."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(sf_dir)


def drain(stream: DataFrame, kind: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is available, into Parquet, and return the written rows."""
    spark = stream.sparkSession
    out = shared_dir(spark, kind)
    query = (
        stream.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint or shared_dir(spark, f"{kind}-ck"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], kind: str) -> None:
    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", shared_dir(stream.sparkSession, f"{kind}-ck"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
