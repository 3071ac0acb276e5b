"""Heart-rate variability of one ECG window, as expressions on its sample array.

All arrays are bounded by the window size; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GATE_PERCENTILE = 0.7
MIN_BEAT_SECONDS = 0.3
RR_MIN_MS = 300.0
RR_MAX_MS = 1500.0
PNN_MS = 50.0

PEAK = "struct<p:int,h:double>"


def min_distance(fs: float) -> int:
    return int(MIN_BEAT_SECONDS * fs)


def with_run_starts(df: DataFrame, samples: str, out: str = "__starts") -> DataFrame:
    """Indexes at which a run of equal values begins."""
    x = F.col(f"`{samples}`")
    starts = F.filter(
        F.sequence(F.lit(0), F.size(x) - 1),
        lambda i: (i == 0) | (F.get(x, i) != F.get(x, i - 1)),
    )
    return df.withColumn(out, starts)


def with_local_maxima(df: DataFrame, samples: str, threshold: Column, out: str = "peaks") -> DataFrame:
    """Strict local maxima not below the threshold; a plateau counts once, at its middle.

    The first and last run can never be a peak.
    """
    df = with_run_starts(df, samples)
    x, s = F.col(f"`{samples}`"), F.col("__starts")
    n_runs = F.size(s)
    candidates = F.transform(s, lambda start, r: F.struct(
        F.floor((start + F.get(s, r + 1) - 1) / 2).cast("int").alias("p"),
        F.get(x, start).alias("h"),
        ((r > 0) & (r < n_runs - 1)
         & (F.get(x, start) > F.get(x, F.get(s, r - 1)))
         & (F.get(x, start) > F.get(x, F.get(s, r + 1)))).alias("top"),
    ))
    peaks = F.transform(
        F.filter(candidates, lambda c: c.top & (c.h >= threshold)),
        lambda c: F.struct(c.p.alias("p"), c.h.alias("h")),
    )
    return df.withColumn(out, peaks).drop("__starts")


def suppress(peaks: Column, distance: int) -> Column:
    """Keep the tallest peaks first and drop what lies closer than ``distance`` to a kept one.

    Of two equally tall peaks the later one is visited first. Returns positions in order.
    """
    if distance <= 1:
        return F.transform(peaks, lambda c: c.p)
    by_height = F.reverse(F.array_sort(F.transform(peaks, lambda c: F.struct(c.h.alias("h"), c.p.alias("p")))))
    kept = F.aggregate(
        by_height,
        F.array().cast("array<int>"),
        lambda acc, c: F.when(
            F.forall(acc, lambda k: F.abs(k - c.p) >= distance), F.concat(acc, F.array(c.p)),
        ).otherwise(acc),
    )
    return F.array_sort(kept)


def _diffs(values: Column) -> Column:
    tail = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    head = F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0)))
    return F.zip_with(tail, head, lambda b, a: b - a)


def rr_intervals(positions: Column, fs: float) -> Column:
    """Plausible beat intervals in milliseconds."""
    in_ms = F.transform(_diffs(positions), lambda d: d / F.lit(float(fs)) * 1000.0)
    return F.filter(in_ms, lambda v: (v > RR_MIN_MS) & (v < RR_MAX_MS))


def with_hrv(df: DataFrame, rr: str = "rr") -> DataFrame:
    """Five variability figures from intervals; all 0 with fewer than two intervals."""
    def mean(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)

    enough = F.size(rr) >= 2
    df = df.withColumns({
        "__d": _diffs(F.col(rr)),
        "__m": F.when(enough, mean(F.col(rr))),
    })
    d, m = F.col("__d"), F.col("__m")
    ss = F.aggregate(F.col(rr), F.lit(0.0), lambda a, v: a + (v - m) * (v - m))
    jumps = F.size(F.filter(d, lambda v: F.abs(v) > PNN_MS))

    def guarded(value: Column) -> Column:
        return F.when(enough, value).otherwise(F.lit(0.0))

    return df.withColumns({
        "hrv_rmssd": guarded(F.sqrt(mean(F.transform(d, lambda v: v * v)))),
        "hrv_sdnn": guarded(F.sqrt(ss / (F.size(rr) - 1))),
        "hrv_mean_rr": guarded(m),
        "hrv_pnn50": guarded(jumps / F.size(d) * 100.0),
        "hrv_hr": guarded(60000.0 / m),
    }).drop("__d", "__m")


def hrv_features(arrays: DataFrame, ecg: str, threshold: Column, fs: float, distance: int | None = None) -> DataFrame:
    """Window arrays in, the five figures added."""
    df = with_local_maxima(arrays, ecg, threshold, "__peaks")
    df = df.withColumn("__kept", suppress(F.col("__peaks"), distance or min_distance(fs)))
    df = df.withColumn("rr", rr_intervals(F.col("__kept"), fs))
    return with_hrv(df).drop("rr", "__peaks", "__kept")
