"""Sliding-window admission: a request passes if fewer than N were *admitted* in the last W seconds.

Rejected requests do not count, so admission depends on earlier admissions and no window frame
expresses it. Each decision needs only the last N admitted times of its key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sensorloom.operators import ordering
from sensorloom.schema import RATE_LIMIT_REQUESTS, RATE_LIMIT_SECONDS
from sensorloom.session import spread

MICROS = 1_000_000


def admit(times: np.ndarray, recent: list[int], limit: int, window: int) -> tuple[np.ndarray, list[int]]:
    """Decide ordered times (microseconds) given the last admitted ones.

    Jumps from one admission to the next, so a flood of rejections costs a binary search only.
    """
    passed = np.zeros(len(times), dtype=bool)
    kept = list(recent)[-limit:]
    i = 0
    while i < len(times):
        if len(kept) >= limit:  # the oldest of the last N must have left the window
            i = max(i, int(np.searchsorted(times, kept[-limit] + window, side="left")))
            if i >= len(times):
                break
        passed[i] = True
        kept = (kept + [int(times[i])])[-limit:]
        i += 1
    return passed, kept


def limit_batch(
    requests: DataFrame, key: str, ts: str, request_id: str, *, limit: int = RATE_LIMIT_REQUESTS,
    window_sec: float = RATE_LIMIT_SECONDS, target_bytes: int | None = None,
) -> DataFrame:
    """Add ``allowed`` to a table of requests.

    A pause of a whole window forgets everything before it, so a key falls into independent
    sessions. A task holds a batch of rows and the last admitted times, however long a session is.
    """
    window = int(window_sec * MICROS)
    t = requests.withColumn("__t", F.unix_micros(F.col(ts).cast("timestamp")))
    order = ["__t", request_id]
    blocks, blocked = ordering.order_blocks(t, F.col("__t"), target_bytes)
    lagged = ordering.previous_value(blocks, [key], order, {"__t": "__prev"}, blocked=blocked)
    starts = lagged.withColumn("__new", F.when(F.col("__t") - F.col("__prev") < window, 0).otherwise(1).cast("long"))
    blocks, blocked = ordering.order_blocks(starts, F.col("__t"), target_bytes)
    counted = ordering.running_before(blocks, [key], [F.col(c) for c in order], "__new", "__past", blocked=blocked)
    session = counted.withColumn("__session", F.col("__past") + F.col("__new")).drop("__past", "__new", "__prev")
    fields = [f for f in requests.schema.fields]
    schema = T.StructType([*fields, T.StructField("allowed", T.BooleanType())])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, recent = None, []  # the last row's key and session, and what its session admitted last
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [batch.column(c) for c in (key, "__session")]
            ids = [pa.concat_arrays([i[:1] if last is None else b, i]) for i, b in zip(ids, last or ids)]
            codes = [pc.fill_null(i.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False) for i in ids]
            begins = (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])
            t = pc.fill_null(batch.column("__t"), 0).to_numpy(zero_copy_only=False)  # a row without a time is a session of its own
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(begins), [len(t)]]))
            passed = np.zeros(len(t), bool)
            for start, end in zip(cuts, cuts[1:]):
                passed[start:end], recent = admit(t[start:end], [] if begins[start] else recent, limit, window)
            last = [i[-1:] for i in ids]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(passed)], names=schema.names)

    # A session may be as long as its key: it passes through the task in order, a batch at a time.
    dealt = spread(session, [key, "__session"]).sortWithinPartitions(key, "__session", "__t", F.col(request_id).asc_nulls_last())
    return dealt.mapInArrow(decide, schema)


def limit_stream(
    requests: DataFrame, key: str, ts: str, request_id: str, *, limit: int = RATE_LIMIT_REQUESTS,
    window_sec: float = RATE_LIMIT_SECONDS, lateness: str = "10 minutes",
) -> DataFrame:
    """The same on a stream: (key, request_id, event time, allowed).

    State per key is at most ``limit`` times; it is dropped once the watermark has passed the window.
    """
    window = int(window_sec * MICROS)
    stream = requests.select(key, request_id, F.col(ts).cast("timestamp").alias("event_time")).withWatermark("event_time", lateness)
    out = T.StructType([
        stream.schema[key], stream.schema[request_id], T.StructField("event_time", T.TimestampType()), T.StructField("allowed", T.BooleanType())])
    state_type = T.StructType([T.StructField("recent", T.ArrayType(T.LongType()))])

    def decide(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(parts), ignore_index=True)
        pdf = pdf.assign(__t=pdf["event_time"].astype("datetime64[us]").astype("int64")).sort_values(["__t", request_id], ignore_index=True)
        recent = list(state.get[0]) if state.exists else []
        passed, kept = admit(pdf["__t"].to_numpy(), recent, limit, window)
        state.update((kept,))
        last = max(int(pdf["__t"].iat[-1]), kept[-1]) // 1000
        state.setTimeoutTimestamp(max(last + window // 1000, state.getCurrentWatermarkMs() + 1))
        yield pdf.assign(allowed=passed)[[f.name for f in out.fields]]

    return stream.groupBy(key).applyInPandasWithState(decide, out, state_type, "append", GroupStateTimeout.EventTimeTimeout)
