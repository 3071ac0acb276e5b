"""Count windows on a stream: samples wait in a buffer until the watermark has passed them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sensorloom.functions import labels as L
from sensorloom.operators.windows import WindowSpec

_BUFFER = ["t", "tie", "x", "label"]


def _state(tie: T.DataType) -> T.StructType:
    kinds = (T.LongType(), tie, T.DoubleType(), T.IntegerType())
    return T.StructType([T.StructField("next_window", T.LongType()), *(T.StructField(c, T.ArrayType(k)) for c, k in zip(_BUFFER, kinds))])


def _output(key: T.StructField) -> T.StructType:
    return T.StructType([
        key, T.StructField("window_id", T.LongType()), T.StructField("mean", T.DoubleType()), T.StructField("std", T.DoubleType()),
        T.StructField("min", T.DoubleType()), T.StructField("max", T.DoubleType()), T.StructField("label", T.IntegerType()),
    ])


def _order(t: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Places by (time, tie). The ties get their own type back, so that numpy sorts them."""
    return np.lexsort((np.array(ties.tolist()), t.astype("int64")))


def _windows(key: str, subject, first: int, x: np.ndarray, label: np.ndarray, spec: WindowSpec) -> pd.DataFrame | None:
    """All complete windows over ordered samples, or None."""
    n = (len(x) - spec.size) // spec.step + 1 if len(x) >= spec.size else 0
    if not n:
        return None
    at = (np.arange(n) * spec.step)[:, None] + np.arange(spec.size)[None, :]
    w, wl = x[at], label[at]
    votes = np.stack([(wl == c).sum(axis=1) for c in range(wl.max() + 1)], axis=1)
    return pd.DataFrame({
        key: subject, "window_id": first + np.arange(n), "mean": w.mean(axis=1), "std": w.std(axis=1), "min": w.min(axis=1),
        "max": w.max(axis=1), "label": votes.argmax(axis=1).astype("int32")})


def window_stream(
    samples: DataFrame, spec: WindowSpec, *, key: str = "subject_id", ts: str = "ts", tie: str = "event_id", value: str = "x",
    label: str = "label", lateness: str = "10 minutes", idle_ms: int | None = None,
) -> DataFrame:
    """Emit each complete window once: mean, population deviation, extremes, majority label.

    A sample waits in its subject's buffer until the watermark (the newest time seen less ``lateness``)
    reaches it; then no earlier one can come, and it enters the windows in (time, tie) order, so rows that arrive out of order
    give the same windows as a batch. Spark drops rows that are older than the watermark and counts them in
    the query's progress (``numRowsDroppedByWatermark``).

    State per subject: the samples of the last ``lateness`` and less than one window. With ``idle_ms`` a subject
    without samples for that long past the watermark is forgotten, its incomplete window with it.
    """
    stream = samples.where(L.is_valid(F.col(label))).select(
        key, F.date_trunc("MILLISECOND", F.col(ts).cast("timestamp")).alias("event_time"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"),
        F.col(tie).alias("tie"), F.col(value).cast("double").alias("x"), F.col(label).cast("int").alias("label"),
    ).withWatermark("event_time", lateness)

    def advance(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nxt, *held = state.get if state.exists else (0, [], [], [], [])
        columns = [[np.asarray(h, dtype=object if c == "tie" else None)] for c, h in zip(_BUFFER, held)]
        for pdf in parts:  # a part is one Arrow batch; only its columns are kept
            for c, name in zip(columns, _BUFFER):
                c.append(pdf[name].to_numpy())
        t, ties, x, lab = (np.concatenate([p for p in c if len(p)]) if any(map(len, c)) else np.zeros(0) for c in columns)
        order = _order(t, ties)
        t, ties, x, lab = t[order].astype("int64"), ties[order], x[order].astype(float), lab[order].astype(int)
        passed = state.getCurrentWatermarkMs()
        final = int(np.searchsorted(t // 1000, passed, "right"))
        done = _windows(key, k[0], nxt, x[:final], lab[:final], spec)
        used = 0
        if done is not None:
            used = len(done) * spec.step
            nxt += len(done)
            yield done
        if not len(t) or (idle_ms is not None and final == len(t) and t[-1] // 1000 + idle_ms <= passed):
            state.remove()
            return
        state.update((int(nxt), t[used:].tolist(), ties[used:].tolist(), x[used:].tolist(), lab[used:].tolist()))
        if final < len(t):  # wake up when the next sample has become final
            state.setTimeoutTimestamp(max(passed, int(t[final]) // 1000 - 1))
        elif idle_ms is not None:
            state.setTimeoutTimestamp(max(passed, int(t[-1]) // 1000 + idle_ms))

    return stream.groupBy(key).applyInPandasWithState(
        advance, _output(stream.schema[key]), _state(stream.schema["tie"].dataType), "append", GroupStateTimeout.EventTimeTimeout)


def open_windows(spark: SparkSession, checkpoint: str, spec: WindowSpec, key: T.StructField) -> DataFrame:
    """Complete windows still in the buffers of a stopped stream, as if the watermark had passed all samples."""
    state = spark.read.format("statestore").load(checkpoint)
    rows = state.select(F.col(f"key.{state.schema['key'].dataType.names[0]}").alias(key.name), "value.groupState.*")

    def finish(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                order = _order(np.asarray(r.t), np.asarray(r.tie, dtype=object))
                done = _windows(key.name, getattr(r, key.name), r.next_window, np.asarray(r.x, float)[order], np.asarray(r.label, int)[order], spec)
                if done is not None:
                    yield done

    return rows.mapInPandas(finish, _output(key))
