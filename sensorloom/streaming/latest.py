"""The latest result per id as keyed state with a lifetime.

A value state holds each id's newest row by (time, tie). An event-time timer stands at that time plus the lifetime; when the watermark passes it, the
state goes, so memory holds only ids that are alive. A newer row moves the timer. Rows come as rows, as most ids have few: a data frame for each would cost far more than
its rows, and a call to the state is a message, so an id takes no more of them than it needs.
The state is read through Spark's state data source, also after the stream has stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTING = "spark.sql.streaming.stateStore.providerClass"
STATE = "latest"


@contextmanager
def provider(spark: SparkSession) -> Iterator[None]:
    """Streams started within use the RocksDB state store, which keyed state variables need; the session's own setting comes back after."""
    before = spark.conf.get(SETTING, None)
    spark.conf.set(SETTING, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(SETTING) if before is None else spark.conf.set(SETTING, before)


class Latest(StatefulProcessor):
    def __init__(self, held: T.StructType, tie: str, ttl_ms: int):
        self.held, self.tie, self.ttl_ms = held, tie, ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.latest = handle.getValueState(STATE, self.held)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = self.held.names

        def place(row) -> tuple:  # a missing tie is the largest
            tie = row[self.tie]
            return row["t"], tie is None, 0 if tie is None else tie

        state = self.latest.get()
        before = best = None if state is None else dict(zip(names, state))
        newest = None
        for row in rows:
            if newest is None or place(row) >= place(newest):
                newest = row
        if newest is not None and (before is None or place(newest) > place(before)):
            best = {n: newest[n] for n in names}
        if best is not before and best["t"] // 1000 + self.ttl_ms > timerValues.getCurrentWatermarkInMs():
            if before is not None:  # the only timer of an id stands at the end of its row's lifetime
                self.handle.deleteTimer(before["t"] // 1000 + self.ttl_ms)
            self.latest.update(tuple(best[n] for n in names))
            self.handle.registerTimer(best["t"] // 1000 + self.ttl_ms)
            yield Row(**{n: best[n] for n in names if n != "t"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.latest.clear()
        return iter(())

    def close(self) -> None:
        pass


def latest_stream(entries: DataFrame, key: str, time: str, ttl_seconds: int, *, tie: str = "seq", lateness: str = "10 minutes") -> DataFrame:
    """Each change of an id's newest row; the state behind it is what ``read`` shows. Start it within ``provider``. Rows without a time are left out."""
    fields = [f for f in entries.schema.fields if f.name != time]
    own = entries.withColumn(time, F.col(time).cast("timestamp")).where(F.col(time).isNotNull()).withWatermark(time, lateness)
    own = own.withColumn("t", F.unix_micros(time))
    out = T.StructType(fields)
    processor = Latest(T.StructType([T.StructField("t", T.LongType()), *fields]), tie, ttl_seconds * 1000)
    return own.groupBy(key).transformWithState(processor, out, "Append", "EventTime")


def read(spark: SparkSession, checkpoint: str, time: str, now: Column | None = None, ttl_seconds: int | None = None) -> DataFrame:
    """The rows in the state, ``time`` as a timestamp; with ``now`` only those whose lifetime has not ended by then."""
    state = spark.read.format("statestore").option("stateVarName", STATE).load(checkpoint)
    rows = state.select("value.*").withColumn(time, F.timestamp_micros("t")).drop("t")
    return rows if now is None else rows.where(F.unix_timestamp(now) - F.unix_timestamp(time) <= ttl_seconds)
