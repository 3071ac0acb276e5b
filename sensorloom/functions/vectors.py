"""Expressions on feature vectors kept as ``array<double>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorloom.schema import (
    CHANNELS, MANUAL_EPSILON, MANUAL_HRV, MANUAL_IQR_SHARE, MANUAL_MAX_SHARE, MANUAL_MIN_SHARE,
    MANUAL_STD_SHARE, SPECTRAL_STATS,
)


def truncate(vector: Column, width: int | Column) -> Column:
    """Cut a vector to the width a model was trained on; shorter vectors stay whole."""
    return F.slice(vector, F.lit(1), F.lit(width) if isinstance(width, int) else width)


def means_only(vector: Column, n_channels: int = len(CHANNELS)) -> Column:
    """The channel means are the first block of a stat-major vector."""
    return truncate(vector, n_channels)


def channel_groups(vector: Column, widths: list[int]) -> Column:
    """Split a vector into consecutive groups of the given widths."""
    starts = [1 + sum(widths[:i]) for i in range(len(widths))]
    return F.array(*[F.slice(vector, s, w) for s, w in zip(starts, widths)])


def manual_vector(readings: list[Column]) -> Column:
    """Window features made up from one reading per channel. Plain arithmetic on the given columns,
    so the whole vector is generated code."""
    def spread(share: float) -> list[Column]:
        return [(F.abs(v) + MANUAL_EPSILON) * share for v in readings]

    def scaled(share: float) -> list[Column]:
        return [v * share for v in readings]

    flat = [F.lit(0.0)] * len(readings)
    by_stat = [
        readings, spread(MANUAL_STD_SHARE), scaled(MANUAL_MIN_SHARE), scaled(MANUAL_MAX_SHARE),
        readings, spread(MANUAL_IQR_SHARE), flat, flat,
    ]
    spectral = flat * len(SPECTRAL_STATS)
    return F.array(*[v for stat in by_stat for v in stat], *spectral, *[F.lit(v) for v in MANUAL_HRV])


def named(vector: Column, names: list[str]) -> Column:
    """``array<struct<pos, feature, value>>``; positional names when the width does not fit."""
    known = F.array(*[F.lit(n) for n in names])
    fits = F.size(vector) == len(names)
    return F.transform(
        vector,
        lambda v, i: F.struct(
            i.alias("pos"),
            F.when(fits, F.get(known, i)).otherwise(F.concat(F.lit("F"), i.cast("string"))).alias("feature"),
            v.alias("value"),
        ),
    )
