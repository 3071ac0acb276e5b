import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import learn, windows
from sensorloom.operators.windows import WindowSpec
from sensorloom.streaming import logs, rate_limit, run, score
from sensorloom.streaming import windows as stream_windows

RNG = np.random.default_rng(2)


def brute_limit(times, limit, window):
    admitted, out = [], []
    for t in times:
        live = [a for a in admitted if t - a < window]
        out.append(len(live) < limit)
        if out[-1]:
            admitted.append(t)
    return out


@pytest.mark.parametrize("limit,window", [(1, 5), (3, 60), (10, 60)])
def test_admission_against_a_list(limit, window):
    for _ in range(20):
        t = np.sort(RNG.integers(0, 400, 120))
        got, kept = rate_limit.admit(t, [], limit, window)
        assert list(got) == brute_limit(t, limit, window)
        cut = 50
        first, state = rate_limit.admit(t[:cut], [], limit, window)
        second, _ = rate_limit.admit(t[cut:], state, limit, window)
        assert list(first) + list(second) == list(got) and len(kept) <= limit


def requests(spark):
    """A burst with rejections in between, an event exactly a window old, a quiet key."""
    base = [0] * 12 + [30, 59, 60, 60, 61, 119, 120, 200, 201]
    rows = [("burst", i, t) for i, t in enumerate(base)] + [("quiet", 100 + i, 70 * i) for i in range(5)]
    rows += [("busy", 1000 + i, int(t)) for i, t in enumerate(np.sort(RNG.integers(0, 600, 300)))]
    df = spark.createDataFrame(rows, "key string, id long, t long")
    return df.select("key", "id", F.timestamp_seconds(F.col("t") + 1_700_000_000).alias("ts"), "t")


def expected(df, limit=10, window=60):
    want = {}
    rows = sorted((r.key, r.t, r.id) for r in df.collect())
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        want.update(zip([r[2] for r in mine], brute_limit([r[1] for r in mine], limit, window)))
    return want


def test_limit_batch(spark):
    df = requests(spark)
    want = expected(df)
    got = rate_limit.limit_batch(df, "key", "ts", "id")
    assert {r.id: r.allowed for r in got.collect()} == want
    assert want[10] is False and want[14] is True
    cut = rate_limit.limit_batch(df, "key", "ts", "id", target_bytes=3000)
    assert {r.id: r.allowed for r in cut.collect()} == want


def test_limit_batch_holds_a_batch_of_a_long_session(spark):
    """One session over many Arrow batches, more keys, null keys, null times and repeated rows; no session is a group of its own in Python."""
    rows = [(k, i * 7 % 400 * 1_000_000, i) for i in range(400) for k in ("a", "b", None)] + [("a", None, 500), ("a", None, 501), ("b", 3_000_000, 0)]
    df = spark.createDataFrame(rows, "key string, t long, id long").select("key", F.timestamp_micros("t").alias("ts"), "id")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        out = rate_limit.limit_batch(df, "key", "ts", "id", limit=2, window_sec=30, target_bytes=1 << 62)
        got = sorted(((r.key or "", -1 if r.ts is None else r.ts.timestamp(), r.id), r.allowed) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for k in ("a", "b", None):
        mine = sorted((t // 1_000_000, i) for key, t, i in rows if key == k and t is not None)
        want += [((k or "", float(t), i), ok) for (t, i), ok in zip(mine, brute_limit([t for t, _ in mine], 2, 30))]
    want += [(("a", -1, 500), True), (("a", -1, 501), True)]
    assert got == sorted(want)
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()


def staged(df, path, order, parts):
    """Write consecutive slices as files, oldest first."""
    import time

    pdf = df.toPandas().sort_values(order)
    for i, idx in enumerate(np.array_split(np.arange(len(pdf)), parts)):
        df.sparkSession.createDataFrame(pdf.iloc[idx], df.schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_limit_stream_over_several_batches(spark, tmp_path):
    df = requests(spark)
    stream = staged(df, str(tmp_path / "in"), ["ts", "id"], 5)
    out = run.drain(rate_limit.limit_stream(stream.drop("t"), "key", "ts", "id"), "t-limit")
    assert {r.id: r.allowed for r in out.collect()} == expected(df)


def batch_windows(df, spec):
    found = windows.aggregate(windows.reindex(df, ["ts", "event_id"], leading=F.col("ts")), spec,
                              [F.avg("x").alias("mean"), windows.majority(F.col("label")).alias("label")])
    return {(r.subject_id, r.window_id): (round(r.mean, 9), r.label) for r in found.collect()}


def streamed_windows(stream, spec, path, **options):
    checkpoint = str(path / "ck")
    got = run.drain(stream_windows.window_stream(stream, spec, **options), "t-win", checkpoint)
    left = stream_windows.open_windows(got.sparkSession, checkpoint, spec, got.schema["subject_id"])
    first, rest = got.collect(), left.collect()
    rows = {(r.subject_id, r.window_id): (round(r.mean, 9), r.label) for r in first + rest}
    assert len(rows) == len(first) + len(rest)
    return rows, len(first)


@pytest.mark.parametrize("lateness", ["10 minutes", "10 seconds"])
def test_window_stream_equals_batch(spark, tmp_path, lateness):
    n = 240
    rows = [("ab"[i % 2], i, i // 3, float(v), int(c)) for i, (v, c) in enumerate(zip(RNG.normal(size=n), RNG.integers(0, 4, n)))]
    df = spark.createDataFrame(rows, "subject_id string, event_id long, t long, x double, label int").withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000)).drop("t")
    spec = WindowSpec(10, 4)
    got, early = streamed_windows(staged(df, str(tmp_path / "in"), ["ts", "event_id"], 6), spec, tmp_path, lateness=lateness)
    assert got == batch_windows(df, spec) and (early > 0) == (lateness == "10 seconds")


def test_window_stream_keeps_rows_out_of_order(spark, tmp_path):
    """Samples 4 and 5 change places between files; a row far behind the watermark is left out."""
    times = [0, 1, 2, 3, 5, 4, 6, 7, 2000, 2001, 2002, 2003, 1, 2004]
    df = spark.createDataFrame([("s", i, t, float(t), 1, i) for i, t in enumerate(times)], "subject_id string, event_id long, t long, x double, label int, place int")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000))
    got, early = streamed_windows(staged(df, str(tmp_path / "in"), ["place"], 7).drop("t", "place"), WindowSpec(4, 4), tmp_path, lateness="10 minutes")
    assert got == batch_windows(df.where("place != 12"), WindowSpec(4, 4)) and early == 2 and len(got) == 3


def test_history_log_is_idempotent_and_capped(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("T", f"2026-01-01 00:{i // 60:02d}:{i % 60:02d}", i, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "tracking_id string, t string, seq long, stress_ratio double")
    df = df.select("tracking_id", F.to_timestamp("t").alias("captured_at"), "seq", "stress_ratio")
    write = logs.history_writer(path, 10)
    for b, (lo, hi) in enumerate([(0, 15), (10, 30), (30, 40)]):
        write(df.where(f"seq >= {lo} and seq < {hi}"), b)
        write(df.where(f"seq >= {lo} and seq < {hi}"), b)  # a replay
    seqs = sorted(r.seq for r in logs.read_history(spark, path, df.schema, 10).collect())
    assert seqs == list(range(30, 40))
    logs.compact(spark, path, str(tmp_path / "small"), df.schema, 10)
    again = logs.read_history(spark, str(tmp_path / "small"), df.schema, 10)
    assert sorted(r.seq for r in again.collect()) == seqs
    now = F.to_timestamp(F.lit("2026-01-01 00:01:00"))
    assert logs.read_latest(spark, path, df.schema, now, 60).first().seq == 39
    assert logs.read_latest(spark, path, df.schema, now, 20).count() == 0


def test_score_stream_equals_batch(spark, tmp_path):
    from tests.test_learn import blobs

    df, _, _ = blobs(spark, 60)
    model = learn.fit(df, "Decision Tree", {"depth": 4})
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = run.drain(score.score_stream(stream, model, "vec_id").select("vec_id", "prediction", "p_stress"), "t-score")
    want = {r.vec_id: r.prediction for r in model.score(df, "vec_id").collect()}
    assert {r.vec_id: r.prediction for r in got.collect()} == want
    near = learn.fit(df, "KNN")
    got = run.drain(score.score_stream(stream, near, "vec_id").select("vec_id", "prediction"), "t-near")
    assert {r.vec_id: r.prediction for r in got.collect()} == {r.vec_id: r.prediction for r in near.score(df, "vec_id").collect()}
