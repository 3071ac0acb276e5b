"""Time-domain statistics per window and channel, and windows as one bounded array per channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators import window_chunks
from sensorloom.operators import windows as win
from sensorloom.schema import TIME_STATS

CONSTANT_KURTOSIS = -3.0  # batch convention for a channel without variance
CONSTANT_KURTOSIS_SINGLE = 0.0  # single-window convention


def stat_name(channel: str, stat: str) -> str:
    return f"{channel}_{stat}"


def ordered_samples(channels: list[str], pos: str = "pos") -> Column:
    """Collect a window's rows in order; bounded by the window size."""
    values = [F.col(f"`{c}`").cast("double").alias(c) for c in channels]
    return F.array_sort(F.collect_list(F.struct(F.col(pos), *values)))


def window_arrays(
    samples: DataFrame, spec: win.WindowSpec, channels: list[str], *, keys: list[str] = ["subject_id"],
    extra: list[Column] | None = None,
) -> DataFrame:
    """One row per complete window with one ordered ``array<double>`` per channel."""
    grouped = win.aggregate(samples, spec, [ordered_samples(channels).alias("__rows"), *(extra or [])], keys=keys)
    # A lambda, not a field access: the optimizer copies field accesses into every later expression.
    return grouped.withColumns({c: F.transform("__rows", lambda r: r.getField(c)) for c in channels}).drop("__rows")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def quantile(ordered: Column, q: float, size: int) -> Column:
    """Linear interpolation between the two nearest of ``size`` sorted values."""
    at = (size - 1) * q
    lo = int(at)
    low = F.get(ordered, F.lit(lo))
    if at == lo:
        return low
    return low + (F.get(ordered, F.lit(lo + 1)) - low) * F.lit(at - lo)


def time_stats(
    samples: DataFrame, spec: win.WindowSpec, channels: list[str], *, keys: list[str] = ["subject_id"],
    constant_kurtosis: float = CONSTANT_KURTOSIS,
) -> DataFrame:
    """Wide frame: eight statistics per channel and window, from chunks of windows."""
    return window_chunks.window_table(samples, spec, channels, keys=keys, constant_kurtosis=constant_kurtosis)


def long_stats(stats: DataFrame, channels: list[str], ids: list[str], names: list[str] = TIME_STATS) -> DataFrame:
    """Wide to one row per channel, statistics as columns. A narrow step."""
    per_channel = F.array(*[
        F.struct(F.lit(c).alias("channel"), *[F.col(f"`{stat_name(c, s)}`").alias(s) for s in names])
        for c in channels
    ])
    # The outer form: the plain one adds a size filter that copies all of the above below it.
    return stats.select(*ids, F.inline_outer(per_channel))
