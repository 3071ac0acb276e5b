"""Spectral features of windows held as arrays.

Energy needs no transform (Parseval); the dominant bin and the entropy do, so one Arrow function
runs a batched real FFT per channel. Everything around it stays in the JVM.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.operators.stats import total

TIE = 1e-9
NOISE = 1e-12

SPECTRUM_TYPE = T.StructType([
    T.StructField("bin", T.IntegerType()),
    T.StructField("total", T.DoubleType()),
    T.StructField("entropy", T.DoubleType()),
])


def _power(batch: pd.Series) -> np.ndarray:
    return np.abs(np.fft.rfft(np.stack(batch.to_numpy()), axis=1))


def _top_bin(mag: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Largest bin above DC. Bins equal up to rounding noise tie, and the lowest of them wins."""
    if mag.shape[1] < 2:
        return np.zeros(len(mag), dtype=int)
    peak = mag[:, 1:].max(axis=1)
    slack = np.maximum(TIE * peak, NOISE * np.sqrt(power))
    return (mag[:, 1:] >= (peak - slack)[:, None]).argmax(axis=1) + 1


# Plain (not iterator) functions: the calls for all channels then share one Python exchange.
@F.pandas_udf(T.ArrayType(T.DoubleType()))
def magnitudes(batch: pd.Series) -> pd.Series:
    """One-sided magnitude spectrum of equally long windows."""
    return pd.Series(list(_power(batch)) if len(batch) else [], dtype=object)


@F.pandas_udf(SPECTRUM_TYPE)
def spectrum(batch: pd.Series) -> pd.DataFrame:
    """Dominant bin without DC (lowest on a tie), total power and base-2 entropy of the power."""
    if not len(batch):
        return pd.DataFrame({"bin": [], "total": [], "entropy": []})
    bins, power, bits = figures(np.stack(batch.to_numpy()))
    return pd.DataFrame({"bin": bins.astype("int32"), "total": power, "entropy": bits})


def figures(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dominant bin, total power, entropy) of each row of samples."""
    mag = np.abs(np.fft.rfft(windows, axis=1))
    psd = mag**2
    power = psd.sum(axis=1)
    share = psd / np.where(power > 0, power, 1.0)[:, None]
    bits = np.log2(share, out=np.zeros_like(share), where=share > 0)
    return _top_bin(mag, power), power, -(share * bits).sum(axis=1)


def window_figures(fs: float, size: int) -> dict:
    """The spectral statistics as functions of window matrices, for :func:`window_chunks.window_table`."""

    def of(windows: np.ndarray) -> np.ndarray:
        bins, power, bits = figures(windows)
        return np.stack([bins * float(fs) / float(size), power, bits])

    return {"dom_freq spectral_energy spectral_entropy": of}


def dominant_frequency(bin_: Column, fs: float, size: int) -> Column:
    return bin_ * F.lit(float(fs)) / F.lit(float(size))


def energy(samples: Column, size: int) -> Column:
    """Sum of squared one-sided magnitudes, from the samples alone."""
    squares = total(F.transform(samples, lambda v: v * v)) * size
    dc = F.pow(total(samples), 2)
    if size % 2:
        return (squares + dc) / 2
    signed = total(F.transform(samples, lambda v, i: F.when(i % 2 == 0, v).otherwise(-v)))
    return (squares + dc + F.pow(signed, 2)) / 2


def energy_aggregate(x: Column, pos_in_window: Column, size: int) -> Column:
    """The same as an aggregate over sample rows: no arrays, partial sums before the shuffle."""
    squares = F.sum(x * x) * size
    dc = F.pow(F.sum(x), 2)
    if size % 2:
        return (squares + dc) / 2
    signed = F.sum(F.when(pos_in_window % 2 == 0, x).otherwise(-x))
    return (squares + dc + F.pow(signed, 2)) / 2


def entropy(psd: Column) -> Column:
    """Base-2 entropy of a power array, 0 for silence: log2(T) - sum(v * log2 v) / T."""
    power = total(psd)
    weighted = F.aggregate(psd, F.lit(0.0), lambda a, v: a + F.when(v > 0, v * F.log2(v)).otherwise(0.0))
    return F.when(power == 0, F.lit(0.0)).otherwise(F.log2(power) - weighted / power)


def spectrum_columns(channels: list[str]) -> dict[str, Column]:
    return {f"__spec_{c}": spectrum(F.col(f"`{c}`")) for c in channels}


def finish_spectrum(df: DataFrame, channels: list[str], fs: float, size: int) -> DataFrame:
    """Spectrum columns to dominant frequency, energy and entropy."""
    cols = {}
    for c in channels:
        cols[f"{c}_dom_freq"] = dominant_frequency(F.col(f"`__spec_{c}`.bin"), fs, size)
        cols[f"{c}_spectral_energy"] = F.col(f"`__spec_{c}`.total")
        cols[f"{c}_spectral_entropy"] = F.col(f"`__spec_{c}`.entropy")
    return df.withColumns(cols).drop(*[f"__spec_{c}" for c in channels])


def spectral_stats(arrays: DataFrame, channels: list[str], fs: float, size: int) -> DataFrame:
    """Add dominant frequency, energy and entropy of every channel to a frame of window arrays."""
    return finish_spectrum(arrays.withColumns(spectrum_columns(channels)), channels, fs, size)
