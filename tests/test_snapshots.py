"""The history under snapshots against the plain functions on one table."""

import pytest
from pyspark.sql import functions as F

from sensorloom.operators import history
from sensorloom.sources import snapshots
from sensorloom.streaming import run

SCHEMA = "tracking_id string, t long, seq long, stress_ratio double"


def entries(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("tracking_id", F.timestamp_seconds("t").alias("captured_at"), "seq", "stress_ratio")


def batch(spark, ids, days, first=0):
    return entries(spark, [(f"T{i}", 86_400 * d, first + i * 1000 + d, d / 1000) for i in ids for d in days])


def rows(df):
    return sorted((r.tracking_id or "", r.seq, r.captured_at is None, r.stress_ratio) for r in df.collect())


def test_append_replay_compact_and_old_snapshots(spark, tmp_path):
    root = str(tmp_path / "h")
    parts = [batch(spark, range(30), range(0, 40, 5)), batch(spark, range(10, 20), range(38, 80, 3), 50_000), batch(spark, [3], range(90, 140))]
    odd = entries(spark, [(None, 86_400, 1, 0.1), (None, None, 2, 0.2), ("T3", None, 3, 0.3), ("T3", 86_400 * 200, 4, None), ("T3", 86_400 * 200, 4, None)])
    parts.append(odd)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    want = rows(history.newest(whole.dropDuplicates(["tracking_id", "captured_at", "seq"]), 20))
    for b, p in enumerate(parts):
        snapshots.append(p, root, b, buckets=8)
    assert rows(snapshots.read(spark, root, 20)) == want
    before = snapshots.versions(spark, root)[-1]
    snapshots.append(parts[2], root, 2)  # a replay
    assert rows(snapshots.read(spark, root, 20)) == want
    old = snapshots.read(spark, root, 20, version=before)
    assert snapshots.compact(spark, root, 20) and snapshots.compact(spark, root, 20) is None
    assert {r.level for r in snapshots.files(spark, root).collect()} == {1}
    assert rows(snapshots.read(spark, root, 20)) == want == rows(old)
    snapshots.append(parts[1], root, 1)  # a replay of what is compacted
    assert rows(snapshots.read(spark, root, 20)) == want
    snapshots.compact(spark, root, 20)
    assert snapshots.vacuum(spark, root) > 0 and len(snapshots.versions(spark, root)) == 1
    assert rows(snapshots.read(spark, root, 20)) == want


def test_compaction_rewrites_what_was_touched(spark, tmp_path):
    root = str(tmp_path / "h")
    snapshots.append(batch(spark, range(400), [1, 40]), root, 0, buckets=100)
    snapshots.compact(spark, root, 50)
    before = {r.file for r in snapshots.files(spark, root).collect()}
    snapshots.append(batch(spark, [7], [80]), root, 1)
    assert snapshots.compact(spark, root, 50, share=0.9) is None  # too little is new
    snapshots.compact(spark, root, 50)
    after = {r.file for r in snapshots.files(spark, root).collect()}
    assert len(before) > 150 and len(before - after) <= 0.02 * len(before)


def test_reads_open_few_files(spark, tmp_path):
    root = str(tmp_path / "h")
    df = batch(spark, range(50), range(0, 720, 20))
    snapshots.append(df, root, 0, buckets=10)
    bounds = {"start": "1970-04-01T00:00:00", "end": "1970-05-01T00:00:00"}
    want = [(r.captured_at, r.seq) for r in history.in_range(history.newest(df, 30), "T7", **bounds).collect()]

    def opened(**kw):
        return snapshots.chosen_files(spark, root, **kw).count()

    def got():
        return [(r.captured_at, r.seq) for r in snapshots.read(spark, root, 30, "T7", **bounds).collect()]

    live = snapshots.files(spark, root).count()
    assert got() == want and opened(tracking_id="T7") <= live / 8
    snapshots.compact(spark, root, 30)
    live = snapshots.files(spark, root).count()
    assert got() == want and opened(tracking_id="T7", **bounds) <= 2 and opened(**bounds) <= live / 5
    full = batch(spark, [7], range(0, 720, 20))
    assert want == [(r.captured_at, r.seq) for r in history.in_range(history.newest(full, 30), "T7", **bounds).collect()]


def test_second_writer_fails_and_missing_table_raises(spark, tmp_path):
    root = str(tmp_path / "h")
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, root, 5)
    assert snapshots.compact(spark, root, 5) is None and snapshots.chosen_files(spark, root).count() == 0
    df = batch(spark, [1], [1])
    snapshots.append(df, root, 0, buckets=2)
    stale = snapshots._pointer(spark, root)
    snapshots.append(batch(spark, [2], [1]), root, 1)
    with pytest.raises(Exception, match="already exists|FileAlreadyExists"):
        snapshots._publish(snapshots.files(spark, root, stale["version"]), root, stale, df.schema, snapshots._layout(stale))
    assert snapshots.read(spark, root, 5).count() == 2
    snapshots.append(df.where("seq < 0"), root, 2)  # an empty batch
    assert snapshots.read(spark, root, 5).count() == 2


def test_stream_into_snapshots(spark, tmp_path):
    from tests.test_streaming import staged

    df = batch(spark, range(5), range(30))
    stream = staged(df, str(tmp_path / "in"), ["captured_at", "seq"], 3)
    root = str(tmp_path / "h")
    run.drain_batches(stream, lambda b, i: snapshots.append(b, root, i, buckets=4), "t-snap")
    assert rows(snapshots.read(spark, root, 7)) == rows(history.newest(df, 7))
