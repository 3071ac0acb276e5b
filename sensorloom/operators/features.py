"""The full window feature vector: samples are shuffled once, in chunks of windows, and not copied per window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.clean import sanitize_features
from sensorloom.operators import hrv, spectral, stats, window_chunks
from sensorloom.operators import windows as win
from sensorloom.schema import HRV_STATS, SPECTRAL_STATS, TIME_STATS


def window_features(
    samples: DataFrame, spec: win.WindowSpec, channels: list[str], fs: float, *, ecg: str,
    keys: list[str] = ["subject_id"], constant_kurtosis: float = stats.CONSTANT_KURTOSIS,
    distance: int | None = None,
) -> DataFrame:
    """(keys, window_id, label, features): statistics of every channel, then spectra, then HRV.

    One group job votes on the label and makes statistics and spectra from each chunk of windows; only the heart channel's windows
    leave it as arrays, for the HRV expressions.
    """
    df = window_chunks.window_table(
        samples, spec, channels, keys=keys, constant_kurtosis=constant_kurtosis, label="label", gates={ecg: hrv.GATE_PERCENTILE},
        arrays=[ecg], also=spectral.window_figures(fs, spec.size))
    df = hrv.hrv_features(df, ecg, F.col(f"`{stats.stat_name(ecg, '_gate')}`"), fs, distance)
    return df.select(*keys, "window_id", "label", sanitize_features(stat_vector(channels)).alias("features"))


def stat_vector(channels: list[str]) -> Column:
    per_channel = [F.col(f"`{c}_{s}`") for s in TIME_STATS + SPECTRAL_STATS for c in channels]
    return F.array(*per_channel, *[F.col(h) for h in HRV_STATS])
