"""Joins of sensor streams and of what is stored about a subject."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def positional(streams: list[DataFrame], keys: list[str]) -> DataFrame:
    """Zip streams by sample index. The inner join cuts all of them to the shortest.

    Keys include the sample index, so a single long subject spreads over all tasks.
    """
    return reduce(lambda a, b: a.join(b, keys), streams)


def with_flags(items: DataFrame, key: str, stores: dict[str, DataFrame]) -> DataFrame:
    """One existence flag per store. Stores are reduced to distinct keys first."""
    for name, store in stores.items():
        present = store.select(key).distinct().withColumn(name, F.lit(True))
        items = items.join(present, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return items


def to_compute(models: DataFrame, features: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Keys with a model and features but without a result."""
    ready = models.select(key).distinct().join(features.select(key).distinct(), key, "left_semi")
    return ready.join(results.select(key), key, "left_anti")


def first_available(sources: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Per key the row of the first source that has it; ``source`` tells which."""
    ranked = [df.withColumns({"source": F.lit(name), "__p": F.lit(i)}) for i, (name, df) in enumerate(sources)]
    stacked = reduce(lambda a, b: a.unionByName(b), ranked)
    w = W.partitionBy(key).orderBy("__p")
    return stacked.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__p")


def truth_and_prediction(truth: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    return truth.join(predictions, keys)


def latest(versions: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Newest version per key; the rank filter trims hot keys before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return versions.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
