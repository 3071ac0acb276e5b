"""Set operations by column name."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union_all(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right)


def union_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both sides are reduced in the map stage of the same distinct."""
    return left.unionByName(right).distinct()


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right.select(*left.columns))
