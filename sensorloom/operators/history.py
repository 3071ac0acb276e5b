"""Per-person result history: append, cap, range, summary, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorloom.functions import bands
from sensorloom.operators import ordering
from sensorloom.schema import HISTORY_CAP, HISTORY_COLUMNS

ID = "tracking_id"
TIME = "captured_at"


def newest(history: DataFrame, n: int, *, tie: str = "seq", rank: str | None = None) -> DataFrame:
    """The ``n`` newest rows per id.

    ``row_number() <= n`` lets Spark cut every map partition to ``n`` rows per id before the
    shuffle, so an id that owns most rows still sends only ``n`` per task.
    """
    w = W.partitionBy(ID).orderBy(F.col(TIME).desc_nulls_last(), F.col(tie).desc())
    ranked = history.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    return ranked.withColumnRenamed("__r", rank) if rank else ranked.drop("__r")


def append(history: DataFrame, entries: DataFrame, cap: int = HISTORY_CAP, *, tie: str = "seq") -> DataFrame:
    """Add entries, then keep the newest ``cap`` of the ids that received some."""
    touched = entries.select(ID).distinct()
    grown = history.join(touched, ID, "left_semi").unionByName(entries)
    return history.join(touched, ID, "left_anti").unionByName(newest(grown, cap, tie=tie))


def in_range(history: DataFrame, tracking_id: str | None = None, start=None, end=None) -> DataFrame:
    """Rows of an id inside optional inclusive bounds; those of one id come in time order. Plain comparisons, so they
    reach the scan. Bounds are compared as timestamps."""
    df = history if tracking_id is None else history.where(F.col(ID) == tracking_id)
    kind = history.schema[TIME].dataType
    if start is not None:
        df = df.where(F.col(TIME) >= F.lit(start).cast(kind))
    if end is not None:
        df = df.where(F.col(TIME) <= F.lit(end).cast(kind))
    return df if tracking_id is None else df.orderBy(F.col(TIME).asc_nulls_first(), *[c for c in ("seq",) if c in df.columns])


def summary(history: DataFrame, *, tie: str = "seq") -> DataFrame:
    """count, latest, previous, delta and trend per id."""
    last_two = newest(history.select(ID, TIME, tie, "stress_ratio"), 2, tie=tie, rank="r")
    pair = last_two.groupBy(ID).agg(
        F.max(F.when(F.col("r") == 1, F.col("stress_ratio"))).alias("latest"),
        F.max(F.when(F.col("r") == 2, F.col("stress_ratio"))).alias("previous"),
    )
    counts = history.groupBy(ID).agg(F.count(F.lit(1)).alias("count"))
    delta = F.round(F.col("latest") - F.col("previous"), 4)
    return counts.join(pair, ID).withColumn("delta", delta).withColumn("trend", bands.trend(F.col("delta")))


def deltas(history: DataFrame, *, tie: str = "seq", target_bytes: int | None = None) -> DataFrame:
    """Change of every entry from the one before it."""
    blocks, blocked = ordering.order_blocks(history, F.unix_micros(F.col(TIME).cast("timestamp")), target_bytes)
    df = ordering.previous_value(blocks, [ID], [TIME, tie], {"stress_ratio": "previous_ratio"}, blocked=blocked)
    return df.withColumn("delta", F.round(F.col("stress_ratio") - F.col("previous_ratio"), 4))


def csv_frame(history: DataFrame) -> DataFrame:
    """The export columns in their fixed order, the map as JSON text, flags in title case."""
    def flag(c: str) -> Column:
        return F.initcap(F.coalesce(F.col(c), F.lit(False)).cast("string")).alias(c)

    cols = []
    for c in HISTORY_COLUMNS:
        if c in ("is_manual", "overall_stress"):
            cols.append(flag(c))
        elif c == "label_counts":
            cols.append(F.coalesce(F.to_json(c), F.lit("{}")).alias(c))
        else:
            cols.append(F.col(c))
    return history.select(*cols)


def decode(stored: DataFrame) -> DataFrame:
    """Stored rows (0/1 flags, JSON text) to typed rows."""
    empty = F.create_map().cast("map<string,bigint>")
    text = F.when(F.length("label_counts") > 0, F.col("label_counts"))
    return stored.withColumns({
        "is_manual": F.col("is_manual").cast("boolean"),
        "overall_stress": F.col("overall_stress").cast("boolean"),
        "label_counts": F.coalesce(F.from_json(text, "map<string,bigint>"), empty),
    })


def encode(history: DataFrame) -> DataFrame:
    """Typed rows to stored rows."""
    return history.withColumns({
        "is_manual": F.coalesce(F.col("is_manual"), F.lit(False)).cast("int"),
        "overall_stress": F.coalesce(F.col("overall_stress"), F.lit(False)).cast("int"),
        "label_counts": F.coalesce(F.to_json("label_counts"), F.lit("{}")),
    })
