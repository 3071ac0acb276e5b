"""Bring series of different rates to a common length."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.operators.chunks import CHUNK, in_groups, with_halo

GRID_HZ = 700
KAISER_BETA = 5.0
TAPS_PER_SIDE = 10
MAX_RATIO = 1000
MIN_POLY_SAMPLES = 8
BLOCK = 65536


def lengths(series: DataFrame, key: str = "subject_id", out: str = "n") -> DataFrame:
    return series.groupBy(key).agg(F.count(F.lit(1)).alias(out))


def _next_sample(series: DataFrame, key: str, pos: str, cols: list[str], block: int = BLOCK) -> DataFrame:
    """Add ``__next_<col>``. Windows run per (key, block of positions); the first row of a block is
    also copied to the block before it, where it only serves as a neighbour."""
    b = F.floor(F.col(pos) / block)
    at_border = (F.col(pos) % block == 0) & (F.col(pos) > 0)
    spread = series.withColumn("__b", F.explode(F.when(at_border, F.array(b, b - 1)).otherwise(F.array(b))))
    w = W.partitionBy(key, "__b").orderBy(pos)
    for c in cols:
        spread = spread.withColumn(f"__next_{c}", F.lead(c).over(w))
    return spread.where(F.floor(F.col(pos) / block) == F.col("__b")).drop("__b")


def linear(series: DataFrame, cols: list[str], target: Column, *, key: str = "subject_id", pos: str = "pos", n: str = "n") -> DataFrame:
    """Interpolate each series to ``target`` points over its whole span.

    Every source interval emits the points that fall into it, so nothing is joined and the length
    of the target grid is never held in one row.
    """
    last_in, last_out = F.col(n) - 1, F.col("__m") - 1
    s = _next_sample(series.withColumn("__m", target.cast("long")), key, pos, cols)
    p = F.col(pos)

    def first_point(at: Column) -> Column:  # ceil(at * last_out / last_in) in whole numbers
        return F.floor((at * last_out + last_in - 1) / last_in)

    lo = F.when(last_in == 0, F.lit(0)).otherwise(first_point(p))
    hi = (
        F.when(last_in == 0, last_out).when(p == last_in, last_out)
        .otherwise(first_point(p + 1) - 1)
    )
    hi = F.when(last_out == 0, F.when(p == 0, F.lit(0)).otherwise(F.lit(-1))).otherwise(hi)
    lo = F.when((last_out == 0) & (p == 0), F.lit(0)).otherwise(lo)
    s = s.withColumns({"__lo": lo.cast("long"), "__hi": hi.cast("long")}).where(F.col("__hi") >= F.col("__lo"))
    points = s.withColumn("__i", F.explode(F.sequence("__lo", "__hi")))
    frac = F.when((last_in == 0) | (last_out == 0), F.lit(0.0)).otherwise(
        (F.col("__i") * last_in - p * last_out) / last_out.cast("double"))
    value = {c: F.col(c) + F.when(frac == 0, F.lit(0.0)).otherwise(frac * (F.col(f"__next_{c}") - F.col(c))) for c in cols}
    return points.select(key, F.col("__i").alias(pos), *[v.alias(c) for c, v in value.items()])


def polyphase_taps(up: int, down: int) -> np.ndarray:
    """Kaiser-windowed sinc low-pass at the narrower of the two bands, unit gain at DC times up."""
    widest = max(up, down)
    half = TAPS_PER_SIDE * widest
    k = np.arange(-half, half + 1)
    taps = np.sinc(k / widest) * np.kaiser(2 * half + 1, KAISER_BETA)
    return taps / taps.sum() * up


def _poly_points(x: np.ndarray, start: int, lo: int, hi: int, up: int, down: int, taps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs centred on source positions [lo, hi); ``x`` begins at source position ``start``."""
    half = len(taps) // 2
    out = np.arange(-(-lo * up // down), -(-hi * up // down))
    at = out * down
    first = -((half - at) // up)  # ceil((at - half) / up)
    src = first[:, None] + np.arange(2 * half // up + 1)[None, :]
    tap = at[:, None] - src * up + half
    inside = (src >= start) & (src < start + len(x)) & (tap >= 0) & (tap < len(taps))
    gathered = np.where(inside, x[np.clip(src - start, 0, len(x) - 1)], 0.0)
    return out, (gathered * np.where(inside, taps[np.clip(tap, 0, len(taps) - 1)], 0.0)).sum(axis=1)


def _linear_points(x: np.ndarray, start: int, lo: int, hi: int, n: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Points of the target grid that fall on source positions [lo, hi)."""
    if n == 1 or target == 1:
        out = np.arange(target if n == 1 else int(lo == 0))
        return out, np.full(len(out), x[0])
    ends = [-(-p * (target - 1) // (n - 1)) for p in (lo, hi)]
    out = np.arange(ends[0], target if hi == n else ends[1])
    j = out * (n - 1) // (target - 1)
    share = (out * (n - 1) - j * (target - 1)) / (target - 1)
    after = x[np.clip(j + 1 - start, 0, len(x) - 1)]
    return out, x[j - start] + share * (after - x[j - start])


def chunked(
    series: DataFrame, cols: list[str], *, key: str = "subject_id", pos: str = "pos", chunk: int = 16384, most_down: int = MAX_RATIO,
) -> DataFrame:
    """Change the rate of each key by its ``method`` column: polyphase (up/down), linear (n/target)
    or same.

    Each chunk computes the outputs centred in it, from its rows and a halo of ten filter periods,
    so one shuffle serves all methods and group sizes are bounded.
    """
    halo = TAPS_PER_SIDE * max(1, most_down) + 1
    size = max(chunk, halo)
    schema = T.StructType([series.schema[key], T.StructField(pos, T.LongType()), *[T.StructField(c, T.DoubleType()) for c in cols]])
    names = [f.name for f in schema.fields]
    known: dict[tuple[int, int], np.ndarray] = {}  # taps of the ratios a task has met

    def run(rows: pa.RecordBatch, own: dict[str, np.ndarray]) -> pa.RecordBatch:
        p = own[pos]
        lo = int(own[CHUNK][0]) * size
        hi = min(lo + size, int(p[-1]) + 1)
        if hi <= lo:  # only halo rows
            at, data = np.empty(0, "int64"), {c: np.empty(0) for c in cols}
        else:
            method = rows.column("method")[0].as_py()
            ratio = int(own["up"][0]), int(own["down"][0])
            if method == "polyphase" and ratio not in known:
                known.clear()
                known[ratio] = polyphase_taps(*ratio)
            data = {}
            for c in cols:
                x = own[c].astype(np.float64)
                if method == "polyphase":
                    at, data[c] = _poly_points(x, int(p[0]), lo, hi, *ratio, known[ratio])
                elif method == "linear":
                    at, data[c] = _linear_points(x, int(p[0]), lo, hi, int(own["n"][0]), int(own["target"][0]))
                else:
                    core = (p >= lo) & (p < hi)
                    at, data[c] = p[core], x[core]
        subject = rows.column(key).take(pa.array(np.zeros(len(at), np.int64)))
        return pa.RecordBatch.from_arrays([subject, pa.array(at, pa.int64()), *(pa.array(v, pa.float64(), from_pandas=True) for v in data.values())], names=names)

    return in_groups(with_halo(series, size, halo, pos), [key, CHUNK], pos, run, schema)


def polyphase(series: DataFrame, cols: list[str], up: int, down: int, **kw) -> DataFrame:
    """FIR rate change of every key by the reduced ratio up/down, zeros outside the series."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    method = "same" if up == down else "polyphase"
    rows = series.withColumns({"up": F.lit(up), "down": F.lit(down), "n": F.lit(0), "target": F.lit(0), "method": F.lit(method)})
    return chunked(rows, cols, most_down=-(-down // up), **kw)


@F.pandas_udf(T.LongType())
def gcd(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.gcd(a.to_numpy(), b.to_numpy()))


def ratios(per_key: DataFrame, n: str = "n", target: str = "target") -> DataFrame:
    """Reduced up/down per key and the method they call for. One row per subject."""
    g = per_key.withColumn("__g", gcd(F.col(n), F.col(target)))
    g = g.withColumns({"up": F.floor(F.col(target) / F.col("__g")), "down": F.floor(F.col(n) / F.col("__g"))}).drop("__g")
    wide = (F.col("up") > MAX_RATIO) | (F.col("down") > MAX_RATIO) | (F.col(n) < MIN_POLY_SAMPLES)
    method = F.when(F.col(n) == F.col(target), "same").when(wide, "linear").otherwise("polyphase")
    return g.withColumn("method", method)


def to_length(series: DataFrame, cols: list[str], targets: DataFrame, *, key: str = "subject_id", pos: str = "pos",
              chunk: int = 16384) -> DataFrame:
    """Resample each key to ``targets.target`` samples by the method its ratio calls for."""
    plan = ratios(lengths(series, key).join(targets.select(key, "target"), key))
    rows = series.select(key, pos, *cols).join(plan, key)
    return chunked(rows, cols, key=key, pos=pos, chunk=chunk)


def expand_to_grid(series: DataFrame, cols: list[str], rate: int, *, keys: list[str] = ["subject_id"], pos: str = "pos",
                   grid: int = GRID_HZ, fill: float | None = 0.0) -> DataFrame:
    """Put sample i at i * round(grid / rate) and fill the slots up to the next one.

    Rates of 32 and 64 overshoot the grid second, so their last four slots of each full second are
    dropped. Every sample emits its own slots; no grid is built or joined.
    """
    step = round(grid / rate)
    p = F.col(pos)
    if rate in (32, 64):
        start = F.floor(p / rate) * (rate * step - 4) + (p % rate) * step
        slots = F.when(p % rate == rate - 1, F.lit(step - 4)).otherwise(F.lit(step))
    else:
        start, slots = p * step, F.lit(step)
    out = series.withColumn("__start", start.cast("long")).withColumn("__k", F.explode(F.sequence(F.lit(0), slots - 1)))
    blank = F.lit(fill).cast("double")
    values = [F.when(F.col("__k") == 0, F.col(c).cast("double")).otherwise(blank).alias(c) for c in cols]
    return out.select(*keys, (F.col("__start") + F.col("__k")).alias(pos), *values)
