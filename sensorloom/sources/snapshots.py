"""A history table as bucketed files under snapshots: append, read merged, compact what was touched.

A commit writes its own folder of files, one or more per (bucket of the id, period of some days), ids in order within a file, then a manifest of all live
files, then a numbered pointer. The pointer is created only if its number is free, so of two writers at once the second fails and nothing is half visible.
Readers take the files of one pointer: later commits don't disturb them until ``vacuum`` drops its folders.

Batches are appended as they come (level 0) and merged on read: a row sent twice counts once, an id keeps its newest ``cap`` rows. ``compact``
rewrites only buckets whose new rows reach a share of their old ones, so rewriting stays in proportion to what is new. A read by id opens the
files of one bucket; a lower bound skips older periods; an upper bound skips newer ones where a bucket is compacted (else they decide who is within the cap).

Nulls: rows without a time lie in a period before all others and come last; a null id is an id of its own bucket.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.operators import history

DAY_S = 86_400
NO_TIME = -(1 << 40)
MANIFEST = "file string, bucket int, period long, level int, batch long, rows long"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _bucket(of: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(of.cast("string")), F.lit(buckets)).cast("int")


def _period(time: Column, days: int) -> Column:
    return F.coalesce(F.floor(F.unix_seconds(time.cast("timestamp")) / (days * DAY_S)), F.lit(NO_TIME)).cast("long")


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, p = _path(spark, f"{root}/pointers")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []


def _pointer(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    known = versions(spark, root)
    if not known:
        return None
    at = known[-1] if version is None else version
    return {**json.loads("".join(r[0] for r in spark.read.text(f"{root}/pointers/{at:012d}").collect())), "version": at}


def files(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The live files of a snapshot (``MANIFEST``); the newest one if none is named."""
    pointer = _pointer(spark, root, version)
    return spark.read.schema(MANIFEST).parquet(pointer["manifest"]) if pointer else spark.createDataFrame([], MANIFEST)


def _write(rows: DataFrame, root: str, layout: dict, level: int, batch: int) -> DataFrame:
    """Write the rows into a new folder; its files as manifest rows. Large (bucket, period) groups are split by adaptive execution."""
    spark, folder = rows.sparkSession, f"{root}/data/{uuid.uuid4().hex}"
    placed = rows.withColumns({"__bucket": _bucket(F.col(history.ID), layout["buckets"]), "__period": _period(F.col(history.TIME), layout["days"])})
    sorted_rows = placed.hint("rebalance", "__bucket", "__period").sortWithinPartitions("__bucket", "__period", history.ID, history.TIME)
    sorted_rows.write.mode("errorifexists").partitionBy("__bucket", "__period").parquet(folder)
    schema = T.StructType([*rows.schema.fields, T.StructField("__bucket", T.IntegerType()), T.StructField("__period", T.LongType())])
    written = spark.read.schema(schema).parquet(folder)
    return written.groupBy(F.col("_metadata.file_path").alias("file"), F.col("__bucket").alias("bucket"), F.col("__period").alias("period")).agg(
        F.count(F.lit(1)).alias("rows")).select("file", "bucket", "period", F.lit(level).alias("level"), F.lit(batch).cast("long").alias("batch"), "rows")


def _publish(live: DataFrame, root: str, pointer: dict | None, schema: T.StructType, layout: dict) -> int:
    spark, version = live.sparkSession, (pointer["version"] if pointer else 0) + 1
    manifest = f"{root}/manifests/{uuid.uuid4().hex}"
    live.coalesce(1).write.parquet(manifest)  # one row per file
    fs, p = _path(spark, f"{root}/pointers/{version:012d}")
    out = fs.create(p, False)  # fails if another writer has taken the number
    out.write(bytearray(json.dumps({"manifest": manifest, "schema": schema.jsonValue(), **layout}).encode()))
    out.close()
    return version


def _layout(pointer: dict) -> dict:
    return {k: pointer[k] for k in ("buckets", "days")}


def append(entries: DataFrame, root: str, batch: int, *, buckets: int = 64, days: int = 30) -> int:
    """Add a batch; a batch of the same number that is not compacted yet is replaced. Returns the new version. ``buckets`` and ``days`` (of a period)
    count for a new table only."""
    spark = entries.sparkSession
    pointer = _pointer(spark, root)
    layout = _layout(pointer) if pointer else {"buckets": buckets, "days": days}
    kept = files(spark, root, pointer and pointer["version"]).where(~((F.col("level") == 0) & (F.col("batch") == batch)))
    return _publish(kept.unionByName(_write(entries, root, layout, 0, batch)), root, pointer, entries.schema, layout)


def _merged(spark: SparkSession, chosen: DataFrame, pointer: dict, cap: int, tie: str) -> DataFrame:
    schema = T.StructType.fromJson(pointer["schema"])
    paths = sorted(r[0] for r in chosen.select("file").collect())  # names only, as Spark's own listing keeps them
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return history.newest(rows.dropDuplicates([history.ID, history.TIME, tie]), cap, tie=tie)


def compact(spark: SparkSession, root: str, cap: int, *, tie: str = "seq", share: float = 0.0) -> int | None:
    """Merge the buckets whose new rows are at least ``share`` of their compacted ones. The new version, or None if there is nothing to do."""
    pointer = _pointer(spark, root)
    if pointer is None:
        return None
    live = files(spark, root, pointer["version"])
    new, old = (F.sum(F.when(F.col("level") == n, F.col("rows")).otherwise(0)) for n in (0, 1))
    due = live.groupBy("bucket").agg(new.alias("new"), old.alias("old")).where((F.col("new") > 0) & (F.col("new") >= share * F.col("old"))).select("bucket")
    chosen = live.join(due, "bucket", "left_semi")
    if chosen.isEmpty():
        return None
    made = _write(_merged(spark, chosen, pointer, cap, tie), root, _layout(pointer), 1, -1)
    rest = live.join(due, "bucket", "left_anti").select(*made.columns)
    return _publish(rest.unionByName(made), root, pointer, T.StructType.fromJson(pointer["schema"]), _layout(pointer))


def chosen_files(spark: SparkSession, root: str, tracking_id=None, start=None, end=None, version: int | None = None) -> DataFrame:
    """The files that a read has to open."""
    pointer = _pointer(spark, root, version)
    live = files(spark, root, version)
    if pointer is None:
        return live
    if tracking_id is not None:
        live = live.where(F.col("bucket") == _bucket(F.lit(tracking_id), pointer["buckets"]))
    if start is not None:
        live = live.where(F.col("period") >= _period(F.lit(start), pointer["days"]))
    if end is not None:
        open_buckets = files(spark, root, version).where("level = 0").select("bucket").distinct()
        live = live.join(open_buckets.withColumn("__open", F.lit(True)), "bucket", "left")
        live = live.where(F.col("__open").isNotNull() | (F.col("period") <= _period(F.lit(end), pointer["days"]))).drop("__open")
    return live


def read(spark: SparkSession, root: str, cap: int, tracking_id=None, start=None, end=None, *, tie: str = "seq", version: int | None = None) -> DataFrame:
    """The newest ``cap`` rows per id, of these the ones within the inclusive bounds; those of one id in time order."""
    pointer = _pointer(spark, root, version)
    if pointer is None:
        raise FileNotFoundError(f"no snapshot below {root}")
    rows = _merged(spark, chosen_files(spark, root, tracking_id, start, end, pointer["version"]), pointer, cap, tie)
    return history.in_range(rows, tracking_id, start, end)


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Drop pointers but the newest ``keep``, and the commit folders that no kept snapshot uses. Returns how many folders went."""
    known, gone = versions(spark, root), 0
    used = {r[0] for v in known[-keep:] for r in files(spark, root, v).select(F.element_at(F.split(F.regexp_extract("file", "/data/([^/]+)/", 1), "/"), 1)).distinct().collect()}
    for v in known[:-keep]:
        fs, p = _path(spark, f"{root}/pointers/{v:012d}")
        fs.delete(p, False)
    fs, data = _path(spark, f"{root}/data")
    for status in fs.listStatus(data) if fs.exists(data) else []:
        if status.getPath().getName() not in used:
            fs.delete(status.getPath(), True)
            gone += 1
    return gone
