"""Queries that run a stream over the stored tables to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.operators import learn
from sensorloom.plans import bindings as B
from sensorloom.plans.registry import query, with_ctes
from sensorloom.session import shared_dir
from sensorloom.sources import snapshots
from sensorloom.streaming import latest, logs, rate_limit, run, score, windows

LIMIT, PER_SECONDS = 3, 3600.0


# Admission as a recursion over admitted events: the next one is the first that finds the oldest of
# the last three at least an hour old.
_LIMIT_SQL = """WITH RECURSIVE ev AS (
  SELECT event_type, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
r AS (
  SELECT event_type, rn, t AS a3, NULL::BIGINT AS a2, NULL::BIGINT AS a1 FROM ev WHERE rn = 1
  UNION ALL
  SELECT event_type, rn, t, a3, a2 FROM (
    SELECT e.event_type, e.rn, e.t, r.a3, r.a2, row_number() OVER (PARTITION BY r.event_type ORDER BY e.rn) AS q
    FROM r JOIN ev e ON e.event_type = r.event_type AND e.rn > r.rn AND (r.a1 IS NULL OR e.t >= r.a1 + 3600000000))
  WHERE q = 1)
SELECT ev.event_type, ev.event_id, r.rn IS NOT NULL AS allowed FROM ev LEFT JOIN r ON r.event_type = ev.event_type AND r.rn = ev.rn"""


@query("st_rate_limit", _LIMIT_SQL)
def st_rate_limit(spark, sf_dir):
    """Three admitted events per hour and event kind."""
    events = run.read_table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    stream = rate_limit.limit_stream(events, "event_type", "ts", "event_id", limit=LIMIT, window_sec=PER_SECONDS)
    return run.drain(stream, "limit").select("event_type", "event_id", "allowed")


@query("st_rate_limit_batch", _LIMIT_SQL)
def st_rate_limit_batch(spark, sf_dir):
    events = B.table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    out = rate_limit.limit_batch(events, "event_type", "ts", "event_id", limit=LIMIT, window_sec=PER_SECONDS)
    return out.select("event_type", "event_id", "allowed")


@query("st_history", with_ctes([B.HIST_SQL], """
SELECT tracking_id, seq, stress_ratio FROM (
  SELECT *, row_number() OVER (PARTITION BY tracking_id ORDER BY captured_at DESC, seq DESC) AS r FROM hist) WHERE r <= 7"""))
def st_history(spark, sf_dir):
    """Batches into a history under snapshots, compacted, read merged."""
    root = shared_dir(spark, "history")
    run.drain_batches(_entries(spark, sf_dir), lambda batch, number: snapshots.append(batch, root, number, buckets=4, days=1000), "history")
    snapshots.compact(spark, root, 7)
    return snapshots.read(spark, root, 7).select("tracking_id", "seq", "stress_ratio")


def _entries(spark, sf_dir):
    orders = run.read_table(spark, sf_dir, "orders")
    return orders.select(
        F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("tracking_id"), F.col("o_orderdate").alias("captured_at"),
        F.col("o_orderkey").alias("seq"), ((F.col("o_orderkey") * 37 % 1001) / 1000.0).alias("stress_ratio"))


@query("st_latest_result", with_ctes([B.HIST_SQL], """
SELECT tracking_id, seq, stress_ratio FROM (
  SELECT *, row_number() OVER (PARTITION BY tracking_id ORDER BY captured_at DESC, seq DESC) AS r FROM hist)
WHERE r = 1 AND captured_at >= TIMESTAMP '2000-01-01' - INTERVAL 365 DAY"""))
def st_latest_result(spark, sf_dir):
    path = shared_dir(spark, "latest")
    entries = _entries(spark, sf_dir)
    run.drain_batches(entries, logs.latest_writer(path), "latest")
    now = F.lit("2000-01-01").cast("timestamp")
    return logs.read_latest(spark, path, entries.schema, now, 365 * 86400).select("tracking_id", "seq", "stress_ratio")


@query("st_latest_state", with_ctes([B.HIST_SQL], """
SELECT tracking_id, seq, stress_ratio FROM (
  SELECT *, row_number() OVER (PARTITION BY tracking_id ORDER BY captured_at DESC, seq DESC) AS r, max(captured_at) OVER () AS last FROM hist)
WHERE r = 1 AND captured_at + INTERVAL 365 DAY > last - INTERVAL 10 MINUTE"""))
def st_latest_state(spark, sf_dir):
    """What the keyed state still holds when the watermark has passed the last entry: newest results younger than a year."""
    checkpoint = shared_dir(spark, "latest-ck")
    with latest.provider(spark):
        run.drain(latest.latest_stream(_entries(spark, sf_dir), "tracking_id", "captured_at", 365 * 86400), "latest", checkpoint)
    return latest.read(spark, checkpoint, "captured_at").select("tracking_id", "seq", "stress_ratio")


@query("st_windows", with_ctes([*B.SIG_LABEL_CTES,
    "st AS (SELECT subject_id, window_id, avg(x) AS mean, stddev_pop(x) AS sd, min(x) AS lo, max(x) AS hi FROM sig_win GROUP BY subject_id, window_id)"], """
SELECT subject_id, window_id, round(mean, 6) AS mean, round(sd, 6) AS std, lo AS "min", hi AS "max", label
FROM st JOIN sig_label USING (subject_id, window_id)"""))
def st_windows(spark, sf_dir):
    events = run.read_table(spark, sf_dir, "events")
    label = F.lit(0)
    for name, code in B.EVENT_LABELS.items():
        label = F.when(F.col("event_type") == name, code).otherwise(label)
    samples = events.select(F.col("user_id").alias("subject_id"), "event_id", "ts", F.col("value").alias("x"), label.alias("label"))
    checkpoint = shared_dir(spark, "windows-ck")
    out = run.drain(windows.window_stream(samples, B.SIG_SPEC), "windows", checkpoint)
    out = out.unionByName(windows.open_windows(spark, checkpoint, B.SIG_SPEC, out.schema["subject_id"]))
    return out.select("subject_id", "window_id", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max", "label")


@query("st_score")
def st_score(spark, sf_dir):
    model = learn.fit(B.feat(spark, sf_dir), "Decision Tree")
    vectors = run.read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    out = run.drain(score.score_stream(vectors, model, "vec_id").drop("features"), "scores")
    return out.select("vec_id", "prediction", "label_name", "is_stressed", F.round("p_stress", 6).alias("p_stress"))
