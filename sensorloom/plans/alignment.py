"""Queries on stream alignment, resampling and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions import clean
from sensorloom.operators import align, filters, graph, ordering, resample, windows
from sensorloom.plans import bindings as B
from sensorloom.plans.registry import query, with_ctes
from sensorloom.sources import recordings


def _streams(spark, sf_dir):
    """A long stream, and a shorter one of the same subjects with its own numbering."""
    chest = B.sig4_pos(spark, sf_dir).select("subject_id", "pos", "quantity", "extendedprice", "label")
    fewer = B.sig4(spark, sf_dir).where(F.col("label") != 3)
    blocks, blocked = ordering.order_blocks(fewer, B.epoch("l_shipdate"))
    wrist = ordering.dense_position(blocks, ["subject_id"], [F.col(c) for c in B.SIG4_ORDER], blocked=blocked)
    return chest, wrist.select("subject_id", "pos", "discount", "tax")


_STREAMS_SQL = """wrist AS (SELECT subject_id, discount, tax, row_number() OVER (PARTITION BY subject_id
                   ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS pos FROM sig4 WHERE label <> 3)"""


@query("join_positional", with_ctes([*B.SIG4_CTES, _STREAMS_SQL], """
SELECT c.subject_id, c.pos, quantity, extendedprice, w.discount, w.tax, label
FROM sig4_pos c JOIN wrist w ON c.subject_id = w.subject_id AND c.pos = w.pos"""))
def join_positional(spark, sf_dir):
    return align.positional(list(_streams(spark, sf_dir)), ["subject_id", "pos"])


@query("join_trunc_min", with_ctes([*B.SIG4_CTES, _STREAMS_SQL,
    "c AS (SELECT subject_id, count(*) AS n FROM wrist GROUP BY subject_id)"], """
SELECT s.subject_id, s.pos, s.quantity, w.tax FROM sig4_pos s JOIN c USING (subject_id)
JOIN wrist w ON w.subject_id = s.subject_id AND w.pos = s.pos WHERE s.pos < least(s.n, c.n)"""))
def join_trunc_min(spark, sf_dir):
    chest, wrist = _streams(spark, sf_dir)
    return align.positional([chest.select("subject_id", "pos", "quantity"), wrist.select("subject_id", "pos", "tax")], ["subject_id", "pos"])


@query("align_nan_expand", with_ctes(B.SIG_CTES, """
SELECT subject_id, (pos // 64) * 700 + (pos % 64) * 11 + k AS pos, CASE WHEN k = 0 THEN x ELSE 0 END AS x
FROM sig_pos, LATERAL (SELECT unnest(generate_series(0, CASE WHEN pos % 64 = 63 THEN 6 ELSE 10 END)) AS k)"""))
def align_nan_expand(spark, sf_dir):
    return resample.expand_to_grid(B.sig_pos(spark, sf_dir), ["x"], 64)


_LINEAR_SQL = """grid AS (SELECT subject_id, n, unnest(generate_series(0, 127)) AS i FROM (SELECT DISTINCT subject_id, n FROM sig_pos)),
place AS (SELECT subject_id, n, i, (i * (n - 1)) // 127 AS j, ((i * (n - 1)) % 127) / 127.0 AS f FROM grid)"""


@query("resample_linear", with_ctes([*B.SIG_CTES, _LINEAR_SQL], """
SELECT g.subject_id, i AS pos, round(a.x + f * (coalesce(b.x, a.x) - a.x), 6) AS x
FROM place g JOIN sig_pos a ON a.subject_id = g.subject_id AND a.pos = j
LEFT JOIN sig_pos b ON b.subject_id = g.subject_id AND b.pos = j + 1"""))
def resample_linear(spark, sf_dir):
    samples = B.sig_pos(spark, sf_dir).select("subject_id", "pos", "x")
    rows = samples.join(resample.lengths(samples), "subject_id")
    out = resample.linear(rows, ["x"], F.lit(128))
    return out.withColumn("x", F.round("x", 6))


# Kaiser taps for the ratio 3/2 (half length 30), Bessel function by its power series.
_TAPS_SQL = """k AS (SELECT unnest(generate_series(-30, 30)) AS k),
raw AS (SELECT k, (CASE WHEN k = 0 THEN 1 ELSE sin(pi() * k / 3.0) / (pi() * k / 3.0) END)
        * list_sum([power(25 * (1 - power(k / 30.0, 2)) / 4, j) / power(gamma(j + 1), 2) FOR j IN generate_series(0, 40)]) AS h FROM k),
taps AS (SELECT k, h / (SELECT sum(h) FROM raw) * 3 AS h FROM raw),
grid AS (SELECT subject_id, n, unnest(generate_series(0, (n * 3 + 1) // 2 - 1)) AS i FROM (SELECT DISTINCT subject_id, n FROM sig_pos))"""


@query("resample_poly", with_ctes([*B.SIG_CTES, _TAPS_SQL], """
SELECT g.subject_id, i AS pos, round(sum(s.x * t.h), 6) AS x
FROM grid g JOIN sig_pos s ON s.subject_id = g.subject_id AND abs(g.i * 2 - s.pos * 3) <= 30
JOIN taps t ON t.k = g.i * 2 - s.pos * 3 GROUP BY g.subject_id, i"""))
def resample_poly(spark, sf_dir):
    samples = B.sig_pos(spark, sf_dir).select("subject_id", "pos", "x")
    return resample.polyphase(samples, ["x"], 3, 2).withColumn("x", F.round("x", 6))


_PHASE_FS = 0.01
_PHASE_SQL = "phase(phase, lo, hi) AS (VALUES " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in graph.phase_bounds(_PHASE_FS)) + ")"


@query("join_phase", with_ctes([B.SIG_SQL, "phase(phase, lo, hi) AS (VALUES " + ", ".join(
    f"('{n}', {a}, {b})" for n, a, b in graph.phase_bounds(432)) + ")"], """
SELECT event_id, phase FROM sig JOIN phase
ON epoch_us(ts) // 1000000 - 1704067200 >= lo AND epoch_us(ts) // 1000000 - 1704067200 < hi"""))
def join_phase(spark, sf_dir):
    """The recording's 100 minutes are spread over the 30 days of events: index = second."""
    second = F.floor(B.epoch("ts") / 1000000) - 1704067200
    samples = B.sig(spark, sf_dir).select("event_id", second.alias("pos"))
    return graph.with_phase(samples, graph.phase_bounds(432)).select("event_id", "phase")


@query("join_truth_pred", with_ctes([*B.PRED_CTES], "SELECT event_id, actual, predicted FROM pred"))
def join_truth_pred(spark, sf_dir):
    """Truth from the samples, predictions from their own table, by row key."""
    predictions = B.pred(spark, sf_dir).select("event_id", "predicted")
    truth = B.sig(spark, sf_dir, valid_only=True).select("event_id", F.col("label").alias("actual"))
    return align.truth_and_prediction(truth, predictions, ["event_id"])


@query("join_availability", with_ctes([B.FEAT_SQL], """
SELECT s.subject_id, count(*) FILTER (vec_id % 2 = 0) > 0 AS has_model, count(*) FILTER (label = 2) >= 1 AS has_cache,
       count(*) FILTER (vec_id % 97 = 0) > 0 AS has_result,
       count(*) FILTER (vec_id % 2 = 0) > 0 AND count(*) FILTER (label = 2) >= 1 AND count(*) FILTER (vec_id % 97 = 0) = 0 AS compute
FROM feat s GROUP BY s.subject_id"""))
def join_availability(spark, sf_dir):
    df = B.feat(spark, sf_dir).select("vec_id", "subject_id", "label")
    models, cache, done = df.where("vec_id % 2 = 0"), df.where("label = 2"), df.where("vec_id % 97 = 0")
    pending = align.to_compute(models, cache, done.select("subject_id").distinct(), "subject_id")
    return align.with_flags(df.select("subject_id").distinct(), "subject_id", {
        "has_model": models, "has_cache": cache, "has_result": done, "compute": pending})


@query("join_first_available", with_ctes([B.HIST_SQL], """
SELECT tracking_id, CASE WHEN m IS NOT NULL THEN 'memory' WHEN s IS NOT NULL THEN 'stored' ELSE 'computed' END AS source,
       coalesce(m, s, c) AS seq
FROM (SELECT tracking_id, max(seq) FILTER (stress_ratio > 0.9) AS m, max(seq) FILTER (is_manual) AS s, max(seq) AS c FROM hist GROUP BY tracking_id)"""))
def join_first_available(spark, sf_dir):
    df = B.hist(spark, sf_dir)

    def newest(rows):
        return rows.groupBy("tracking_id").agg(F.max("seq").alias("seq"))

    tiers = [("memory", newest(df.where("stress_ratio > 0.9"))), ("stored", newest(df.where("is_manual"))), ("computed", newest(df))]
    return align.first_available(tiers, "tracking_id")


# --- Filters -----------------------------------------------------------------------------------


@query("sig_bandpass")
def sig_bandpass(spark, sf_dir):
    samples = B.sig_pos(spark, sf_dir).select("subject_id", "pos", "x")
    return filters.bandpass(samples, "x", 0.2, 1.0, B.SIG_FS)


@query("sig_lowpass")
def sig_lowpass(spark, sf_dir):
    samples = B.sig_pos(spark, sf_dir).select("subject_id", "pos", "x")
    return filters.lowpass(samples, "x", 0.5, B.SIG_FS)


BANK_CHANNELS = {"Chest ECG": "quantity", "Chest EMG": "extendedprice", "Chest EDA": "discount", "Chest Resp": "tax"}


@query("sig_filter_bank")
def sig_filter_bank(spark, sf_dir):
    return filters.filter_bank(B.sig4_pos(spark, sf_dir), BANK_CHANNELS)


# --- Composition -------------------------------------------------------------------------------


_REC_SQL = """chest AS (SELECT *, CASE WHEN label = 3 AND l_linenumber = 7 THEN 0 ELSE label END AS lab FROM sig4_pos),
wrist AS (SELECT subject_id, pos, CASE WHEN discount = 0.05 THEN NULL ELSE discount END AS d FROM sig4_pos),
rec AS (SELECT c.subject_id, c.pos, quantity, extendedprice, tax, coalesce(d, 0) AS d, lab
        FROM chest c JOIN wrist w ON c.subject_id = w.subject_id AND c.pos = w.pos)"""


@query("src_recording", with_ctes([*B.SIG4_CTES, _REC_SQL], """
SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY pos) - 1 AS pos, quantity AS "Chest Acc X",
       extendedprice AS "Chest Acc Y", tax AS "Chest Temp", d AS "Wrist EDA", lab AS label FROM rec WHERE lab IN (1, 2, 3)"""))
def src_recording(spark, sf_dir):
    """Raw streams to labelled samples. The channels bound here are ones the filter bank leaves
    alone, so the composition can be checked in SQL; src_recording_filtered runs the filters too."""
    df = B.sig4_pos(spark, sf_dir)
    label = F.when((F.col("label") == 3) & (F.col("l_linenumber") == 7), 0).otherwise(F.col("label"))
    with_line = windows.reindex(B.sig4(spark, sf_dir), B.SIG4_ORDER, leading=B.epoch("l_shipdate"))
    chest = with_line.select(
        "subject_id", F.col("pos").alias("idx"), F.col("quantity").alias("Chest Acc X"), F.col("extendedprice").alias("Chest Acc Y"),
        F.col("tax").alias("Chest Temp"), label.alias("label"))
    wrist = df.select("subject_id", F.col("pos").alias("idx"), F.when(F.col("discount") != 0.05, F.col("discount")).alias("Wrist EDA"))
    return recordings.labelled_samples(chest, [wrist])


@query("src_recording_filtered")
def src_recording_filtered(spark, sf_dir):
    """The whole path: filter bank on the chest stream, a shorter wrist stream resampled to its
    length, joined, cleaned, unlabelled samples dropped."""
    chest_rows, wrist_rows = _streams(spark, sf_dir)
    chest = chest_rows.select(
        "subject_id", F.col("pos").alias("idx"), F.col("quantity").alias("Chest ECG"), F.col("extendedprice").alias("Chest EDA"), "label")
    wrist = wrist_rows.select("subject_id", F.col("pos").alias("idx"), F.col("discount").alias("Wrist EDA"), F.col("tax").alias("Wrist Temp"))
    return recordings.labelled_samples(chest, [wrist])
