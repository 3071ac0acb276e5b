"""Sanitising and coercing values. Missing data is NaN or NULL and ends up as 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOAT32_MAX = 3.4028234663852886e38


def sanitize_raw(x: Column) -> Column:
    """Raw samples: missing becomes 0, infinities become the largest float."""
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(0.0))
        .when(x == float("inf"), F.lit(FLOAT32_MAX))
        .when(x == float("-inf"), F.lit(-FLOAT32_MAX))
        .otherwise(x)
    )


def sanitize_feature(x: Column) -> Column:
    """Features: missing and infinite become 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def sanitize_features(vector: Column) -> Column:
    return F.transform(vector, sanitize_feature)


def impute(x: Column, value: float = 0.0) -> Column:
    return F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(value))


def sensor_value(readings: Column, sensor: str) -> Column:
    """One reading out of a name -> text map; absent or unparsable is 0."""
    return F.coalesce(F.try_element_at(readings, F.lit(sensor)).try_cast("double"), F.lit(0.0))
