"""Feature importance tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.schema import TOP_IMPORTANCES


def top(importances: DataFrame, n: int = TOP_IMPORTANCES) -> DataFrame:
    """The report's largest entries, five decimals. ``limit`` after a sort keeps n rows per task."""
    return importances.orderBy(F.col("importance").desc(), "pos").limit(n).withColumn("importance", F.round("importance", 5))
