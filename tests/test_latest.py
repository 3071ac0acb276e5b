"""Latest results in keyed state against the newest row of each id."""

from pyspark.sql import functions as F

from sensorloom.streaming import latest, run

def test_newest_rows_live_and_expired_ones_leave_the_state(spark, tmp_path):
    from tests.test_streaming import staged

    rows = [(f"T{i % 5}", i, 100 * i, i / 10) for i in range(40)]
    rows += [("old", 100, 50, 0.1), ("tie", 7, 3900, 0.2), ("tie", 9, 3900, 0.3), ("tie", 8, 3900, 0.4), ("back", 50, 3800, 0.5), ("back", 51, 3700, 0.6)]
    df = spark.createDataFrame(rows, "tracking_id string, seq long, t long, stress_ratio double")
    df = df.select("tracking_id", F.timestamp_seconds(F.col("t") + 1_700_000_000).alias("captured_at"), "seq", "stress_ratio")
    stream = staged(df, str(tmp_path / "in"), ["captured_at", "seq"], 4)
    checkpoint = str(tmp_path / "ck")
    with latest.provider(spark):
        run.drain(latest.latest_stream(stream, "tracking_id", "captured_at", 1000, lateness="60 seconds"), "t-latest", checkpoint)
    assert spark.conf.get(latest.SETTING) != latest.PROVIDER
    held = {r.tracking_id: (r.seq, r.stress_ratio) for r in latest.read(spark, checkpoint, "captured_at").collect()}
    assert held == {"T0": (35, 3.5), "T1": (36, 3.6), "T2": (37, 3.7), "T3": (38, 3.8), "T4": (39, 3.9), "tie": (9, 0.3), "back": (50, 0.5)}
    now = F.timestamp_seconds(F.lit(1_700_000_000 + 3_900))
    assert {r.tracking_id for r in latest.read(spark, checkpoint, "captured_at", now, 100).collect()} == {"T3", "T4", "tie", "back"}


def test_an_id_costs_rows_not_data_frames():
    """No data frame for each id, and no more calls to its state than it needs."""
    from pyspark.sql import Row
    from pyspark.sql import types as T

    calls = []

    class Handle:
        def getValueState(self, *_):
            return self

        def get(self):
            return calls.append("get")

        def __getattr__(self, name):
            return lambda *_: calls.append(name)

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0

    fields = [T.StructField("t", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("ratio", T.DoubleType())]
    own = latest.Latest(T.StructType(fields), "seq", 1000)
    own.init(Handle())
    rows = [Row(t=5_000_000, seq=4, ratio=0.1), Row(t=5_000_000, seq=9, ratio=None), Row(t=4_000_000, seq=11, ratio=0.3)]
    assert list(own.handleInputRows(("a",), iter(rows), Times())) == [Row(seq=9, ratio=None)]
    assert calls == ["get", "update", "registerTimer"]
