"""Column statistics of feature vectors and what is built on them."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.clean import impute

LAYER_NORM_EPS = 1e-5


def vector_stats(df: DataFrame, vector: str = "features") -> DataFrame:
    """One row: mean, population deviation and sample deviation per position."""
    s = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(vector)))
    flat = df.select(s.alias("s")).select(
        vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("var"), F.col("s.count").alias("n"))
    share = (F.col("n") - 1) / F.col("n")
    return flat.select(
        "mean", F.transform("var", lambda v: F.sqrt(v * share)).alias("std_pop"), F.transform("var", F.sqrt).alias("std"), "n")


def _stats_column(stats: DataFrame) -> Column:
    """The one-row statistics as a scalar subquery: computed once, no join."""
    return stats.select(F.struct("*").alias("s")).scalar()


def standardize(df: DataFrame, vector: str = "features", stats: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0."""
    s = _stats_column(stats if stats is not None else vector_stats(df, vector))
    staged = df.withColumn("__s", s)
    centred = F.zip_with(vector, "__s.mean", lambda x, m: x - m)
    scaled = F.zip_with(centred, "__s.std_pop", lambda d, sd: F.when(sd == 0, F.lit(0.0)).otherwise(d / sd))
    return staged.withColumn(vector, scaled).drop("__s")


def impute_vector(df: DataFrame, vector: str = "features", value: float = 0.0) -> DataFrame:
    return df.withColumn(vector, F.transform(vector, lambda v: impute(v, value)))


def class_weights(df: DataFrame, label: str = "label", *, balanced: bool = True) -> DataFrame:
    """Per class: n / (k * n_c), or n / n_c without the class count."""
    from pyspark.sql import Window as W

    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    all_classes = W.partitionBy(F.lit(0))  # one row per class
    total, k = F.sum("n").over(all_classes), F.count(F.lit(1)).over(all_classes)
    return counts.withColumn("weight", total / (F.col("n") * k) if balanced else total / F.col("n"))


def with_class_weight(df: DataFrame, label: str = "label", out: str = "weight", *, balanced: bool = True) -> DataFrame:
    weights = class_weights(df, label, balanced=balanced).select(label, F.col("weight").alias(out))
    return df.join(weights, label)


def recalibrate(df: DataFrame, mean_weight: float, std_weight: float, vector: str = "features") -> DataFrame:
    """Gate every feature by its global mean and sample deviation: weighted mix, normalised over
    the features, through a sigmoid."""
    stats = vector_stats(df, vector)
    mixed = F.zip_with("mean", "std", lambda m, s: m * mean_weight + s * std_weight)

    def mean(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda t, v: t + v) / F.size(a)

    g = stats.select(mixed.alias("g")).withColumn("m", mean(F.col("g")))
    g = g.withColumn("v", mean(F.transform("g", lambda x: (x - F.col("m")) * (x - F.col("m")))))
    gate = F.transform("g", lambda x: 1 / (1 + F.exp(-(x - F.col("m")) / F.sqrt(F.col("v") + LAYER_NORM_EPS))))
    gates = g.select(gate.alias("gate")).scalar()
    staged = df.withColumn("__g", gates)
    return staged.withColumn(vector, F.zip_with(vector, "__g", lambda x, k: x * k)).drop("__g")
