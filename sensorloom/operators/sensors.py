"""Channels and readings: nested to flat, wide to long, threshold dimension and presets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import bands
from sensorloom.schema import BASELINE_LABEL, STRESS_LABEL

SCENARIOS = ["low", "high", "critical"]


def flatten_chest(chest: DataFrame, ids: list[str]) -> DataFrame:
    """Three-axis and single signals to the eight chest columns."""
    axes = [F.get("ACC", F.lit(i)).alias(f"Chest Acc {a}") for i, a in enumerate("XYZ")]
    singles = [F.col(s).alias(f"Chest {s}") for s in ("ECG", "EMG", "EDA", "Temp", "Resp") if s in chest.columns]
    return chest.select(*ids, *axes, *singles)


def flatten_axes(acc: DataFrame, ids: list[str], place: str = "Wrist") -> DataFrame:
    return acc.select(*ids, *[F.get("ACC", F.lit(i)).alias(f"{place} Acc {a}") for i, a in enumerate("XYZ")])


def to_long(samples: DataFrame, ids: list[str], channels: list[str], name: str = "channel", value: str = "value") -> DataFrame:
    return samples.unpivot([F.col(f"`{i}`") for i in ids], [F.col(f"`{c}`") for c in channels], name, value)


def with_band(readings: DataFrame, dim: DataFrame, *, sensor: str = "sensor", value: str = "value") -> DataFrame:
    """Judge long readings by their sensor's thresholds. The dimension has a row per sensor, and Spark doesn't know
    the size of one made from local rows: it is marked, or all readings of a sensor would meet in one task."""
    limits = F.broadcast(dim.select(F.col("sensor").alias(sensor), "high", "critical"))
    return (
        readings.join(limits, sensor, "left")
        .withColumn("band", bands.sensor_band(F.col(value), F.col("high"), F.col("critical")))
        .drop("high", "critical")
    )


def dim_from_samples(samples: DataFrame, channels: list[str], label: str = "label") -> DataFrame:
    """Thresholds from data: low is the baseline centroid, high the stress centroid, critical lies
    half the distance beyond high."""
    aggs = []
    for c in channels:
        low = F.avg(F.when(F.col(label) == BASELINE_LABEL, F.col(c)))
        high = F.avg(F.when(F.col(label) == STRESS_LABEL, F.col(c)))
        aggs.append(F.struct(
            F.lit(c).alias("sensor"), low.alias("low"), high.alias("high"), (high + (high - low) / 2).alias("critical"),
        ).alias(c))
    return samples.agg(F.array(*aggs).alias("dim")).select(F.inline("dim"))


def presets(dim: DataFrame) -> DataFrame:
    """(scenario, sensor, value) rows of the dimension."""
    return dim.unpivot(["sensor"], SCENARIOS, "scenario", "value").select("scenario", "sensor", "value")


def preset_rows(preset: DataFrame, channels: list[str]) -> DataFrame:
    """One scoring row per scenario, one column per sensor."""
    return preset.groupBy("scenario").pivot("sensor", channels).agg(F.first("value"))
