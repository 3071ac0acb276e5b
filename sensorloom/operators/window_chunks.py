"""Statistics of overlapping count windows without a copy of the samples per window.

Each subject's samples are cut into chunks of consecutive windows; a chunk holds its windows' samples once, with a halo shorter than a window at its
end, so the shuffle carries little more than the samples at any overlap. A group is one chunk, bounded whatever the subject's length.

Within a chunk windows are views of its samples, read some ``CELLS`` numbers at a time. Moments take one step per sample position for all windows at
once, in the order of the samples, so that a window's figures don't depend on its chunk. (Summaries per pane, merged, cost less at high overlap, but they differ
in the last bit, which showed in 3 of 14,404 rounded figures that lie on an exact tie.)

A window counts if its samples are all there. NaN sorts last, null reads as NaN.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.operators.windows import WindowSpec
from sensorloom.session import spread

CHUNK_ROWS = 1 << 18
CELLS = 1 << 21
NAMES = ("mean", "std", "min", "max", "median", "iqr", "skew", "kurtosis")


def shape(windows: np.ndarray) -> tuple[np.ndarray, ...]:
    """(sum, m2, m3, m4) of each row by the one-pass update of central moments (Pébay, 2008). Equal values leave exact zeros."""
    columns = np.ascontiguousarray(windows.T)
    total, mean, m2, m3, m4 = (np.zeros(columns.shape[1]) for _ in range(5))
    for n, x in enumerate(columns, start=1):
        total += x
        delta = x - mean
        part = delta / n
        mean += part
        m2 += delta * (delta - part)
        d2, p2 = delta * delta, part * part
        m3 = m3 - 3.0 * part * m2 + delta * (d2 - p2)
        m4 = m4 - 4.0 * part * m3 - 6.0 * p2 * m2 + delta * (delta * d2 - part * p2)
    return total, m2, m3, m4


def at_share(ordered: np.ndarray, q: float) -> np.ndarray:
    """Linear interpolation between the two nearest of each row's sorted values."""
    at = (ordered.shape[1] - 1) * q
    low = int(at)
    return ordered[:, low] if at == low else ordered[:, low] + (ordered[:, low + 1] - ordered[:, low]) * (at - low)


def statistics(windows: np.ndarray, constant_kurtosis: float, gate: float | None) -> dict[str, np.ndarray]:
    """The eight statistics (and the quantile ``_gate``) of each row."""
    size = windows.shape[1]
    total, m2, m3, m4 = shape(windows)
    ordered = np.sort(windows, axis=1)
    flat = m2 == 0
    safe = np.where(flat, 1.0, m2)
    out = {
        "mean": total / size, "std": np.sqrt(m2 / size), "min": ordered[:, 0].copy(), "max": ordered[:, -1].copy(), "median": at_share(ordered, 0.5).copy(),
        "iqr": at_share(ordered, 0.75) - at_share(ordered, 0.25), "skew": np.where(flat, 0.0, np.sqrt(size) * m3 / np.sqrt(safe * safe * safe)),
        "kurtosis": np.where(flat, constant_kurtosis, size * m4 / (safe * safe) - 3.0)}
    return out if gate is None else {**out, "_gate": at_share(ordered, gate).copy()}


def views(x: np.ndarray, rows: np.ndarray, size: int):
    """The windows' samples as matrices of at most ``CELLS`` numbers, or one window."""
    all_windows, some = np.lib.stride_tricks.sliding_window_view(x, size), max(1, CELLS // size)
    for s in range(0, len(rows), some):
        yield all_windows[rows[s : s + some]]


def majority(labels: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Each window's most frequent label, the smallest one on a tie."""
    kinds = np.unique(labels)
    counts = []
    for kind in kinds:
        seen = np.concatenate([[0], np.cumsum(labels == kind)])
        counts.append(seen[rows + size] - seen[rows])
    return kinds[np.argmax(counts, axis=0)]


def window_table(
    samples: DataFrame, spec: WindowSpec, channels: list[str], *, keys: list[str] = ["subject_id"], pos: str = "pos", constant_kurtosis: float,
    label: str | None = None, gates: dict[str, float] | None = None, arrays: list[str] = [],
    also: dict[str, Callable[[np.ndarray], np.ndarray]] | None = None,
) -> DataFrame:
    """Per complete window: keys, ``window_id``, the majority of ``label``, ``{channel}_{statistic}``; ``gates`` adds quantiles as ``{channel}__gate``.

    ``also`` maps a suffix to a function of a matrix of windows; where one function returns several figures, its suffixes are joined by a space.
    ``arrays`` names channels whose samples are returned as well, for steps that need them in order.
    """
    gates, also = gates or {}, also or {}
    per_chunk = max(1, CHUNK_ROWS // spec.step)
    p = F.col(pos)
    first = F.when(p < spec.size, F.lit(0)).otherwise(F.floor((p - spec.size) / spec.step) + 1)
    chunks = F.sequence(F.floor(first / per_chunk).cast("long"), F.floor(p / (spec.step * per_chunk)).cast("long"))
    values = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(channels)]
    cut = samples.select(*keys, p.cast("long").alias("__pos"), *values, *([F.col(label).alias("__label")] if label else []), F.explode(chunks).alias("__chunk"))
    kinds = {f.name: f for f in samples.schema.fields}
    names = [f"{c}_{s}" for c in channels for s in NAMES] + [f"{c}__gate" for c in channels if c in gates]
    names += [f"{c}_{s}" for c in channels for suffixes in also for s in suffixes.split()]
    schema = T.StructType([
        *(T.StructField(k, kinds[k].dataType) for k in keys), T.StructField("window_id", T.LongType()), *([T.StructField("label", kinds[label].dataType)] if label else []),
        *(T.StructField(n, T.DoubleType()) for n in names), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in arrays)])
    whole_label = label is not None and isinstance(kinds[label].dataType, T.IntegralType)
    if label and not whole_label:
        raise TypeError("labels are whole numbers")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__pos").combine_chunks()
        at, chunk = table.column("__pos").to_numpy(), table.column("__chunk")[0].as_py()
        starts = np.arange(chunk * per_chunk, (chunk + 1) * per_chunk) * spec.step
        rows = np.searchsorted(at, starts)
        inside = rows + spec.size <= len(at)
        starts, rows = starts[inside], rows[inside]
        full = (at[rows] == starts) & (at[rows + spec.size - 1] == starts + spec.size - 1)
        starts, rows = starts[full], rows[full]
        out = {k: table.column(k).take(pa.array(np.zeros(len(rows), np.int64))) for k in keys}
        out["window_id"] = pa.array(starts // spec.step)
        if label:
            out["label"] = pa.array(majority(table.column("__label").to_numpy(), rows, spec.size) if len(rows) else [], table.schema.field("__label").type)
        for i, c in enumerate(channels):
            x = np.array(table.column(f"x{i}").to_numpy(), np.float64)
            parts: dict[str, list[np.ndarray]] = {}
            for v in views(x, rows, spec.size) if len(rows) else ():
                found = statistics(v, constant_kurtosis, gates.get(c))
                for group, of in also.items():
                    found.update(zip(group.split(), np.atleast_2d(of(v))))
                for s, figures in found.items():
                    parts.setdefault(s, []).append(figures)
            made = {s: np.concatenate(p) for s, p in parts.items()}
            suffixes = [*NAMES, *(["_gate"] if c in gates else []), *(s for group in also for s in group.split())]
            out.update({f"{c}_{s}": pa.array(made.get(s, np.zeros(0)), pa.float64()) for s in suffixes})
            if c in arrays:
                cells = [pa.array(v.ravel()) for v in views(x, rows, spec.size)] if len(rows) else []
                flat = pa.concat_arrays(cells) if cells else pa.array([], pa.float64())
                out[c] = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * spec.size, pa.int32()), flat)
        return pa.table({f: out[f] for f in schema.names})

    return spread(cut, [*keys, "__chunk"]).groupBy(*keys, "__chunk").applyInArrow(lambda table: run(table), schema)
