"""Count-based sliding windows over densely positioned samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import labels as L
from sensorloom.operators.ordering import dense_position, order_blocks


@dataclass(frozen=True)
class WindowSpec:
    """Size and step in samples."""

    size: int
    step: int

    @staticmethod
    def of(window_sec: float, fs: float, overlap: float = 0.5) -> "WindowSpec":
        # Binary float truncation is part of the contract: 3500 samples at overlap 0.9 step by 349.
        kept = 1 - min(max(overlap, 0.0), 0.99)
        size = int(window_sec * fs)
        return WindowSpec(size, max(1, int(size * kept)))

    @property
    def panes(self) -> int | None:
        """How many steps make a window, when that is a whole number."""
        return self.size // self.step if self.size % self.step == 0 else None

    def count(self, n: Column) -> Column:
        return F.when(n < self.size, F.lit(0)).otherwise(F.floor((n - self.size) / self.step) + 1).cast("long")


def reindex(
    samples: DataFrame, order: list[str], *, key: str = "subject_id", label: str = "label",
    leading: Column | None = None, target_bytes: int | None = None,
) -> DataFrame:
    """Drop unlabelled samples, then number what is left 0, 1, 2 … per subject."""
    kept = samples.where(L.is_valid(F.col(label)))
    blocks, blocked = order_blocks(kept, leading if leading is not None else F.col(order[0]), target_bytes)
    return dense_position(blocks, [key], [F.col(c) for c in order], blocked=blocked)


def assign(samples: DataFrame, spec: WindowSpec, *, pos: str = "pos") -> DataFrame:
    """One row per (sample, window that covers it). Windows may still be incomplete at the end."""
    p = F.col(pos)
    last = F.floor(p / spec.step)
    if spec.step == spec.size:
        return samples.withColumn("window_id", last.cast("long"))
    first = F.when(p < spec.size, F.lit(0)).otherwise(F.floor((p - spec.size) / spec.step) + 1)
    covered = samples.withColumn("window_id", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return covered if spec.panes else covered.where(p < F.col("window_id") * spec.step + spec.size)


def aggregate(
    samples: DataFrame, spec: WindowSpec, aggs: list[Column], *, keys: list[str] = ["subject_id"], pos: str = "pos",
) -> DataFrame:
    """Aggregate complete windows. The row count inside the group tells completeness, so no
    per-subject length has to be joined in; a group never exceeds the window size."""
    return (
        assign(samples, spec, pos=pos)
        .groupBy(*keys, "window_id")
        .agg(F.count(F.lit(1)).alias("n_samples"), *aggs)
        .where(F.col("n_samples") == spec.size)
    )


def majority(label: Column) -> Column:
    """Most frequent label, the smallest one on a tie."""
    return F.mode(label, True)


def label_windows(samples: DataFrame, spec: WindowSpec, *, keys: list[str] = ["subject_id"]) -> DataFrame:
    return aggregate(samples, spec, [majority(F.col("label")).alias("label")], keys=keys)


def pane_label_windows(
    samples: DataFrame, spec: WindowSpec, labels: list[int], *, keys: list[str] = ["subject_id"],
    means: list[str] | None = None,
) -> DataFrame:
    """Majority label (and channel means) by panes: samples shrink to one row per step before any
    of them is copied into an overlapping window. Needs a step that divides the size."""
    if not spec.panes:
        raise ValueError("pane windows need a step that divides the window size")
    sums = [F.sum(c).alias(f"__s_{c}") for c in means or []]
    counts = [F.count_if(F.col("label") == v).alias(f"__c_{v}") for v in labels]
    panes = (
        samples.groupBy(*keys, F.floor(F.col("pos") / spec.step).cast("long").alias("__pane"))
        .agg(F.count(F.lit(1)).alias("__n"), *counts, *sums)
    )
    p = F.col("__pane")
    spread = panes.withColumn("window_id", F.explode(F.sequence(F.greatest(p - (spec.panes - 1), F.lit(0)), p)))
    votes = [F.sum(f"__c_{v}").alias(f"__c_{v}") for v in labels]
    joined = (
        spread.groupBy(*keys, "window_id")
        .agg(F.sum("__n").alias("n_samples"), *votes, *[F.sum(f"__s_{c}").alias(f"__s_{c}") for c in means or []])
        .where(F.col("n_samples") == spec.size)
    )
    votes = F.array(*[F.col(f"__c_{v}") for v in labels])
    winner = F.element_at(F.array(*[F.lit(v) for v in labels]), F.array_position(votes, F.array_max(votes)).cast("int"))
    return joined.select(
        *keys, "window_id", "n_samples", winner.alias("label"),
        *[(F.col(f"__s_{c}") / spec.size).alias(f"{c}_mean") for c in means or []],
    )
