"""Threshold chains: ratio bands, verdicts, sensor bands, score colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorloom.schema import OVERALL_STRESS_RATIO, RATIO_BANDS, SINGLE_BANDS, TREND_DELTA


def _band(bands: list[tuple]) -> Column:
    _, level, colour, gauge = bands
    return F.struct(
        F.lit(level).alias("stress_level"),
        F.lit(colour).alias("stress_level_color"),
        F.lit(gauge).alias("gauge_class"),
    )


def _chain(ratio: Column, bands: list[tuple]) -> Column:
    *bounded, last = bands
    expr = None
    for b in bounded:
        expr = F.when(ratio < b[0], _band(b)) if expr is None else expr.when(ratio < b[0], _band(b))
    return expr.otherwise(_band(last))


def stress_band(ratio: Column, is_manual: Column) -> Column:
    """Half-open bands; a single reading is judged as a class probability."""
    return F.when(is_manual, _chain(ratio, SINGLE_BANDS)).otherwise(_chain(ratio, RATIO_BANDS))


def overall_stress(ratio: Column, is_manual: Column, first_stressed: Column) -> Column:
    return F.when(is_manual, first_stressed).otherwise(ratio > OVERALL_STRESS_RATIO)


def verdict_band(ratio: Column, is_manual: Column, first_stressed: Column) -> Column:
    """As :func:`stress_band`, but a single non-stress prediction always reads as the lowest band."""
    calm = is_manual & ~first_stressed
    return F.when(calm, _band(RATIO_BANDS[0])).otherwise(stress_band(ratio, is_manual))


def trend(delta: Column) -> Column:
    return (
        F.when(delta > TREND_DELTA, "up")
        .when(delta < -TREND_DELTA, "down")
        .otherwise("stable")
    )


def score_band(ratio: Column) -> Column:
    return F.when(ratio > 0.4, "red").when(ratio > 0.2, "orange").otherwise("green")


def sensor_band(value: Column, high: Column, critical: Column) -> Column:
    """A threshold of zero (or none) is not applied."""
    def applies(limit: Column) -> Column:
        return F.coalesce(limit, F.lit(0.0)) != 0

    return (
        F.when(applies(critical) & (value >= critical), "critical")
        .when(applies(high) & (value >= high), "stress")
        .otherwise("baseline")
    )
