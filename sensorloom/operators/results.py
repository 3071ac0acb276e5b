"""Scored windows to per-subject results.

A result is split in two: a bounded summary row per subject, and the label sequence in chunks of a
fixed number of windows, so a very long recording never becomes one giant row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import bands
from sensorloom.functions import labels as L
from sensorloom.functions.text import iso_utc
from sensorloom.schema import HISTORY_COLUMNS, LABEL_NAMES, WINDOW_SECONDS

TIMELINE_CHUNK = 4096


def named_only(predictions: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Rows with a known label; as rows, codes and names stay aligned by construction."""
    return predictions.where(L.is_valid(F.col(prediction)))


def counts_map(counts: dict[str, Column]) -> Column:
    """Name -> count for the labels that occur. The keys are a fixed set, so the map is bounded."""
    entries = F.array(*[F.struct(F.lit(n).alias("key"), c.cast("long").alias("value")) for n, c in counts.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e.value > 0))


def summarise(
    predictions: DataFrame, method: str, *, key: str = "subject_id", prediction: str = "prediction",
    order: str = "window_id", confidence: str | None = None, captured_at: Column | None = None,
) -> DataFrame:
    """One result row per subject from one partial aggregation.

    ``confidence`` is P(stress) of a row; it replaces the ratio only for subjects with exactly one
    prediction (known or not).
    """
    p = F.col(prediction)
    counts = [F.count_if(p == code).alias(f"__n_{code}") for code in LABEL_NAMES]
    valid = L.is_valid(p)
    conf = F.max(confidence) if confidence else F.lit(None).cast("double")
    agg = predictions.groupBy(key).agg(
        F.count(F.lit(1)).alias("__n"), F.count_if(valid).alias("total_windows"), *counts,
        conf.alias("__conf"),
        F.min_by(F.when(valid, p), F.when(valid, F.col(order))).alias("__first_label"),
        F.min_by(p, F.col(order)).alias("__first"),
    )
    single = F.col("__n") == 1
    agg = agg.withColumns({
        "label_counts": counts_map({n: F.col(f"__n_{c}") for c, n in LABEL_NAMES.items()}),
        "stress_confidence": F.when(single, F.col("__conf")),
        "__ratio": L.stress_ratio(F.col("__n_2"), F.col("__n_1")),
    })
    agg = agg.withColumns({
        "stress_ratio": F.coalesce("stress_confidence", "__ratio"),
        "is_manual": (F.col("total_windows") == 1) & F.col("stress_confidence").isNotNull(),
        "__stressed": L.is_stressed(F.col("__first")),
    })
    return agg.select(
        F.col(key).alias("subject_id"), F.lit(method).alias("method"),
        iso_utc(captured_at if captured_at is not None else F.current_timestamp()).alias("captured_at"),
        "total_windows", "label_counts", "stress_ratio",
        bands.overall_stress(F.col("stress_ratio"), F.col("is_manual"), F.col("__stressed")).alias("overall_stress"),
        F.when(F.col("__first_label").isNotNull(), L.label_name(F.col("__first_label"))).alias("predicted_label"),
        F.lit(WINDOW_SECONDS).alias("window_sec"), "is_manual",
        bands.verdict_band(F.col("stress_ratio"), F.col("is_manual"), F.col("__stressed")).alias("__band"),
    ).select("*", "__band.*").drop("__band")


def timeline(predictions: DataFrame, *, key: str = "subject_id", prediction: str = "prediction",
             order: str = "window_id", chunk: int = TIMELINE_CHUNK) -> DataFrame:
    """Ordered label sequence in chunks of at most ``chunk`` windows."""
    part = F.floor(F.col(order) / chunk).cast("long").alias("chunk")
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(prediction).alias("v"))))
    return (
        predictions.groupBy(key, part).agg(pairs.alias("__p"))
        .select(key, "chunk", F.transform("__p", lambda e: e.o).alias("window_ids"),
                F.transform("__p", lambda e: e.v).alias("labels"))
    )


def attach_metrics(results: DataFrame, metrics: DataFrame) -> DataFrame:
    """Add the evaluation figures of the subject's model, where there are any."""
    return results.join(metrics, "subject_id", "left")


def history_entry(results: DataFrame, tracking_id: Column) -> DataFrame:
    """Result rows as history rows."""
    defaults = {"is_manual": False, "stress_ratio": 0.0, "overall_stress": False, "total_windows": 0}
    cols = []
    for c in HISTORY_COLUMNS:
        if c == "tracking_id":
            cols.append(tracking_id.alias(c))
        elif c in defaults:
            cols.append(F.coalesce(F.col(c), F.lit(defaults[c])).alias(c))
        elif c == "label_counts":
            cols.append(F.coalesce(F.col(c), F.create_map().cast("map<string,bigint>")).alias(c))
        else:
            cols.append(F.col(c))
    return results.select(*cols)


def class_share(rows: DataFrame, label: str = "label", keys: list[str] | None = None) -> DataFrame:
    """Rows per class and their share in percent; the total is taken over the class counts."""
    from pyspark.sql import Window as W

    keys = keys or []
    counts = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(*(keys or [F.lit(0)])))
    return counts.withColumn("share", F.col("n") * 100 / total)
