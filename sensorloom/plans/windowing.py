"""Queries on windows and signal features."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions import bands
from sensorloom.functions import labels as L
from sensorloom.functions.clean import sanitize_features
from sensorloom.operators import features, hrv, spectral, stats, windows
from sensorloom.operators.windows import WindowSpec
from sensorloom.plans import bindings as B
from sensorloom.plans.registry import query, with_ctes
from sensorloom.schema import TIME_STATS

PI = "3.141592653589793"


@query("flagship", with_ctes([
    *B.SIG_LABEL_CTES,
    """r AS (SELECT subject_id, count(*) AS total_windows,
              coalesce(sum(CASE WHEN label = 2 THEN 1.0 ELSE 0 END)
                       / nullif(sum(CASE WHEN label IN (1, 2) THEN 1 ELSE 0 END), 0), 0) AS ratio
       FROM sig_label GROUP BY subject_id)""",
], """SELECT subject_id, total_windows, round(CAST(ratio AS DOUBLE), 6) AS stress_ratio,
        CASE WHEN ratio < 0.2 THEN 'Low Stress' WHEN ratio < 0.4 THEN 'Moderate Stress'
             WHEN ratio < 0.65 THEN 'High Stress' ELSE 'Critical Stress' END AS stress_level
 FROM r"""))
def flagship(spark, sf_dir):
    """Stress ratio and band of every subject, window labels taken as predictions."""
    samples = B.sig_pos(spark, sf_dir)
    wins = windows.pane_label_windows(samples, B.SIG_SPEC, list(L.LABEL_NAMES))
    scored = wins.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("total_windows"),
        L.stress_ratio(
            F.count_if(L.is_stressed(F.col("label"))), F.count_if(L.is_baseline(F.col("label"))),
        ).alias("ratio"),
    )
    return scored.select(
        "subject_id", "total_windows", F.round("ratio", 6).alias("stress_ratio"),
        bands.stress_band(F.col("ratio"), F.lit(False))["stress_level"].alias("stress_level"),
    )


@query("win_reindex", with_ctes(B.SIG_CTES, "SELECT subject_id, event_id, label, pos FROM sig_pos"))
def win_reindex(spark, sf_dir):
    return B.sig_pos(spark, sf_dir).select("subject_id", "event_id", "label", "pos")


@query("win_sliding", with_ctes(B.SIG_WIN_CTES, """
SELECT subject_id, window_id, count(*) AS n_samples, min(pos) AS first_pos, max(pos) AS last_pos,
       round(avg(x), 6) AS mean_x
FROM sig_win GROUP BY subject_id, window_id"""))
def win_sliding(spark, sf_dir):
    return windows.aggregate(
        B.sig_pos(spark, sf_dir), B.SIG_SPEC,
        [F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.round(F.avg("x"), 6).alias("mean_x")],
    )


@query("win_tumbling", with_ctes(B.SIG_CTES, """
SELECT subject_id, pos // 8 AS window_id, count(*) AS n_samples, round(avg(x), 6) AS mean_x
FROM sig_pos GROUP BY subject_id, pos // 8 HAVING count(*) = 8"""))
def win_tumbling(spark, sf_dir):
    spec = WindowSpec.of(2, B.SIG_FS, 0.0)
    return windows.aggregate(B.sig_pos(spark, sf_dir), spec, [F.round(F.avg("x"), 6).alias("mean_x")])


@query("agg_majority", with_ctes(B.SIG_LABEL_CTES, "SELECT subject_id, window_id, label FROM sig_label"))
def agg_majority(spark, sf_dir):
    return windows.label_windows(B.sig_pos(spark, sf_dir), B.SIG_SPEC).select("subject_id", "window_id", "label")


def _stats_sql(constant_kurtosis: str) -> str:
    return with_ctes([
        *B.SIG4_LONG_CTES,
        """m AS (SELECT subject_id, window_id, channel, avg(x) AS mean, stddev_pop(x) AS sd, min(x) AS mn, max(x) AS mx,
              quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3
            FROM sig4_long GROUP BY subject_id, window_id, channel)""",
        """c AS (SELECT l.subject_id, l.window_id, l.channel, avg(power(l.x - m.mean, 3)) AS m3, avg(power(l.x - m.mean, 4)) AS m4
            FROM sig4_long l JOIN m ON l.subject_id = m.subject_id AND l.window_id = m.window_id AND l.channel = m.channel
            GROUP BY l.subject_id, l.window_id, l.channel)""",
    ], f"""SELECT m.subject_id, m.window_id, m.channel, round(mean, 7) AS mean, round(sd, 4) AS std, mn AS "min", mx AS "max",
       round(q2, 6) AS median, round(q3 - q1, 6) AS iqr,
       round(CASE WHEN mn = mx THEN 0 ELSE m3 / power(sd, 3) END, 5) AS skew,
       round(CASE WHEN mn = mx THEN {constant_kurtosis} ELSE m4 / power(sd, 4) - 3 END, 5) AS kurtosis
FROM m JOIN c ON m.subject_id = c.subject_id AND m.window_id = c.window_id AND m.channel = c.channel""")


def _rounded_stats(df):
    digits = {"mean": 7, "std": 4, "median": 6, "iqr": 6, "skew": 5, "kurtosis": 5}
    long = stats.long_stats(df, B.SIG4_CHANNELS, ["subject_id", "window_id"])
    return long.select(
        "subject_id", "window_id", "channel",
        *[F.round(s, digits[s]).alias(s) if s in digits else F.col(s) for s in TIME_STATS],
    )


@query("agg_time_stats", _stats_sql("-3"))
def agg_time_stats(spark, sf_dir):
    return _rounded_stats(stats.time_stats(B.sig4_pos(spark, sf_dir), B.SIG4_SPEC, B.SIG4_CHANNELS))


@query("agg_window_features_single", _stats_sql("0"))
def agg_window_features_single(spark, sf_dir):
    return _rounded_stats(stats.time_stats(
        B.sig4_pos(spark, sf_dir), B.SIG4_SPEC, B.SIG4_CHANNELS,
        constant_kurtosis=stats.CONSTANT_KURTOSIS_SINGLE,
    ))


# Spectrum of the one-channel windows by the definition of the transform, in long form.
DFT_SQL = f"""dft AS (
  SELECT w.subject_id, w.window_id, b.bin,
         sqrt(power(sum(x * cos(2 * {PI} * b.bin * (pos - window_id * 4) / 8.0)), 2)
            + power(sum(x * sin(2 * {PI} * b.bin * (pos - window_id * 4) / 8.0)), 2)) AS mag
  FROM sig_win w JOIN (SELECT unnest(generate_series(0, 4)) AS bin) b ON true
  GROUP BY w.subject_id, w.window_id, b.bin)"""


def _sig_arrays(spark, sf_dir):
    return stats.window_arrays(B.sig_pos(spark, sf_dir), B.SIG_SPEC, ["x"])


@query("sig_rfft", with_ctes([*B.SIG_WIN_CTES, DFT_SQL], """
SELECT subject_id, window_id, bin, bin * 4 / 8.0 AS freq, round(mag, 5) AS magnitude FROM dft"""))
def sig_rfft(spark, sf_dir):
    spec = _sig_arrays(spark, sf_dir).select("subject_id", "window_id", F.posexplode(spectral.magnitudes("x")).alias("bin", "mag"))
    return spec.select(
        "subject_id", "window_id", "bin",
        spectral.dominant_frequency(F.col("bin"), B.SIG_FS, B.SIG_SPEC.size).alias("freq"), F.round("mag", 5).alias("magnitude"),
    )


@query("agg_dom_freq", with_ctes([*B.SIG_WIN_CTES, DFT_SQL], """
SELECT subject_id, window_id, bin * 4 / 8.0 AS dom_freq FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_id, window_id ORDER BY round(mag, 6) DESC, bin) AS r
  FROM dft WHERE bin > 0)
WHERE r = 1"""))
def agg_dom_freq(spark, sf_dir):
    return _sig_arrays(spark, sf_dir).select(
        "subject_id", "window_id",
        spectral.dominant_frequency(spectral.spectrum("x")["bin"], B.SIG_FS, B.SIG_SPEC.size).alias("dom_freq"),
    )


@query("agg_spec_energy", with_ctes([*B.SIG_WIN_CTES, DFT_SQL], """
SELECT subject_id, window_id, round(sum(mag * mag), 6) AS energy FROM dft GROUP BY subject_id, window_id"""))
def agg_spec_energy(spark, sf_dir):
    """By Parseval's identity on sample rows: codegen aggregates only, no Python, no arrays."""
    spec = B.SIG_SPEC
    offset = F.col("pos") - F.col("window_id") * spec.step
    return windows.aggregate(
        B.sig_pos(spark, sf_dir), spec,
        [F.round(spectral.energy_aggregate(F.col("x"), offset, spec.size), 6).alias("energy")],
    ).drop("n_samples")


@query("agg_spec_entropy", with_ctes([
    *B.SIG_WIN_CTES, DFT_SQL,
    "p AS (SELECT *, mag * mag AS psd, sum(mag * mag) OVER (PARTITION BY subject_id, window_id) AS total FROM dft)",
], """
SELECT subject_id, window_id,
       round(sum(CASE WHEN total > 0 AND psd > 0 THEN -(psd / total) * log2(psd / total) ELSE 0 END), 6) AS entropy
FROM p GROUP BY subject_id, window_id"""))
def agg_spec_entropy(spark, sf_dir):
    psd = F.transform(spectral.magnitudes("x"), lambda m: m * m)
    df = _sig_arrays(spark, sf_dir).withColumn("psd", psd)
    return df.select("subject_id", "window_id", F.round(spectral.entropy(F.col("psd")), 6).alias("entropy"))


@query("sig_percentile_gate", with_ctes(B.SIG4_WIN_CTES, """
SELECT subject_id, window_id, round(quantile_cont(extendedprice, 0.7), 5) AS gate
FROM sig4_win GROUP BY subject_id, window_id"""))
def sig_percentile_gate(spark, sf_dir):
    gate = F.round(F.percentile("extendedprice", hrv.GATE_PERCENTILE), 5).alias("gate")
    return windows.aggregate(B.sig4_pos(spark, sf_dir), B.SIG4_SPEC, [gate]).drop("n_samples")


# Peaks: runs of equal values, then strict maxima among the run values at or above the gate.
PEAKS_SQL = """gate AS (
  SELECT subject_id, window_id, quantile_cont(extendedprice, 0.7) AS g FROM sig4_win GROUP BY subject_id, window_id),
step AS (
  SELECT subject_id, window_id, pos - window_id * 16 AS p, extendedprice AS x,
         lag(extendedprice) OVER (PARTITION BY subject_id, window_id ORDER BY pos) AS px
  FROM sig4_win),
runs AS (
  SELECT subject_id, window_id, run, min(p) AS a, max(p) AS b, min(x) AS x FROM (
    SELECT *, sum(CASE WHEN px IS NULL OR px <> x THEN 1 ELSE 0 END)
              OVER (PARTITION BY subject_id, window_id ORDER BY p) AS run FROM step)
  GROUP BY subject_id, window_id, run),
peaks AS (
  SELECT r.subject_id, r.window_id, (a + b) // 2 AS p, x AS h FROM (
    SELECT *, lag(x) OVER w AS lx, lead(x) OVER w AS rx FROM runs
    WINDOW w AS (PARTITION BY subject_id, window_id ORDER BY run)) r
  JOIN gate USING (subject_id, window_id)
  WHERE x > lx AND x > rx AND x >= g)"""


def _sig4_peaks(spark, sf_dir):
    gate = F.percentile("extendedprice", hrv.GATE_PERCENTILE).alias("gate")
    arrays = stats.window_arrays(B.sig4_pos(spark, sf_dir), B.SIG4_SPEC, ["extendedprice"], extra=[gate])
    return hrv.with_local_maxima(arrays, "extendedprice", F.col("gate"))


@query("sig_local_maxima", with_ctes([*B.SIG4_WIN_CTES, PEAKS_SQL], """
SELECT subject_id, window_id, CAST(p AS BIGINT) AS p, h FROM peaks"""))
def sig_local_maxima(spark, sf_dir):
    return _sig4_peaks(spark, sf_dir).select("subject_id", "window_id", F.inline_outer("peaks")).where("p IS NOT NULL").select(
        "subject_id", "window_id", F.col("p").cast("long").alias("p"), "h")


_GREEDY_SQL = """start AS (SELECT subject_id, window_id, list({'h': h, 'p': p} ORDER BY h DESC, p DESC) AS rem FROM peaks GROUP BY subject_id, window_id),
greedy AS (
  SELECT subject_id, window_id, [rem[1].p] AS kept, [x FOR x IN rem IF abs(x.p - rem[1].p) >= 3] AS rem FROM start
  UNION ALL
  SELECT subject_id, window_id, list_append(kept, rem[1].p), [x FOR x IN rem IF abs(x.p - rem[1].p) >= 3] FROM greedy WHERE len(rem) > 0)"""


@query("sig_peak_suppress", with_ctes([*B.SIG4_WIN_CTES, PEAKS_SQL, _GREEDY_SQL], """
SELECT subject_id, window_id, CAST(unnest(kept) AS INTEGER) AS p FROM greedy WHERE len(rem) = 0""").replace("WITH ", "WITH RECURSIVE ", 1))
def sig_peak_suppress(spark, sf_dir):
    kept = hrv.suppress(F.col("peaks"), 3)
    return _sig4_peaks(spark, sf_dir).select("subject_id", "window_id", F.explode_outer(kept).alias("p")).where("p IS NOT NULL")


RR_SQL = """rr AS (
  SELECT subject_id, window_id, p, rr FROM (
    SELECT *, (p - lag(p) OVER (PARTITION BY subject_id, window_id ORDER BY p)) / 4.0 * 1000.0 AS rr FROM peaks)
  WHERE rr > 300 AND rr < 1500)"""


def _sig4_rr(spark, sf_dir):
    df = _sig4_peaks(spark, sf_dir)
    kept = df.withColumn("kept", hrv.suppress(F.col("peaks"), hrv.min_distance(B.SIG_FS)))
    return kept.withColumn("rr", hrv.rr_intervals(F.col("kept"), B.SIG_FS))


@query("win_rr_intervals", with_ctes([*B.SIG4_WIN_CTES, PEAKS_SQL, RR_SQL], """
SELECT subject_id, window_id, row_number() OVER (PARTITION BY subject_id, window_id ORDER BY p) - 1 AS beat, rr FROM rr"""))
def win_rr_intervals(spark, sf_dir):
    return _sig4_rr(spark, sf_dir).select("subject_id", "window_id", F.posexplode_outer("rr").alias("beat", "rr")).where("rr IS NOT NULL").select(
        "subject_id", "window_id", F.col("beat").cast("long").alias("beat"), "rr")


HRV_SQL = """hrv AS (
  SELECT subject_id, window_id, count(*) AS n, sqrt(avg(d * d)) AS rmssd, stddev_samp(rr) AS sdnn, avg(rr) AS mean_rr,
         avg(CASE WHEN d IS NULL THEN NULL WHEN abs(d) > 50 THEN 100.0 ELSE 0.0 END) AS pnn50
  FROM (SELECT *, rr - lag(rr) OVER (PARTITION BY subject_id, window_id ORDER BY p) AS d FROM rr)
  GROUP BY subject_id, window_id HAVING count(*) >= 2)"""

_HRV_COLS = {"hrv_rmssd": "rmssd", "hrv_sdnn": "sdnn", "hrv_mean_rr": "mean_rr", "hrv_pnn50": "pnn50"}


@query("agg_hrv", with_ctes([*B.SIG4_WIN_CTES, PEAKS_SQL, RR_SQL, HRV_SQL], """
SELECT w.subject_id, w.window_id, """ + ", ".join(
    f"round(coalesce({v}, 0), 6) AS {k}" for k, v in _HRV_COLS.items()) + """,
       round(coalesce(60000.0 / mean_rr, 0), 6) AS hrv_hr
FROM (SELECT DISTINCT subject_id, window_id FROM sig4_win) w LEFT JOIN hrv USING (subject_id, window_id)"""))
def agg_hrv(spark, sf_dir):
    df = hrv.with_hrv(_sig4_rr(spark, sf_dir))
    return df.select("subject_id", "window_id", *[F.round(c, 6).alias(c) for c in [*_HRV_COLS, "hrv_hr"]])


# The whole vector, by SQL: time statistics, the transform by definition, HRV.
_VECTOR_CTES = [
    *B.SIG4_LONG_CTES,
    """m AS (SELECT subject_id, window_id, channel, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS mn, max(x) AS mx,
              quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3
            FROM sig4_long GROUP BY subject_id, window_id, channel)""",
    """c AS (SELECT l.subject_id, l.window_id, l.channel, avg(power(l.x - m.mean, 3)) AS m3, avg(power(l.x - m.mean, 4)) AS m4
            FROM sig4_long l JOIN m USING (subject_id, window_id, channel)
            GROUP BY l.subject_id, l.window_id, l.channel)""",
    f"""dft AS (SELECT l.subject_id, l.window_id, l.channel, b.bin,
              power(sum(x * cos(2 * {PI} * b.bin * (pos - window_id * 16) / 32.0)), 2)
            + power(sum(x * sin(2 * {PI} * b.bin * (pos - window_id * 16) / 32.0)), 2) AS psd
            FROM sig4_long l JOIN (SELECT unnest(generate_series(0, 16)) AS bin) b ON true
            GROUP BY l.subject_id, l.window_id, l.channel, b.bin)""",
    """spec AS (SELECT subject_id, window_id, channel, total AS energy,
              sum(CASE WHEN psd > 0 THEN -(psd / total) * log2(psd / total) ELSE 0 END) AS entropy,
              min(CASE WHEN bin > 0 AND sqrt(psd) >= top - greatest(1e-9 * top, 1e-12 * sqrt(total)) THEN bin END) * 4 / 32.0 AS dom
            FROM (SELECT *, sum(psd) OVER (PARTITION BY subject_id, window_id, channel) AS total,
                         max(CASE WHEN bin > 0 THEN sqrt(psd) END) OVER (PARTITION BY subject_id, window_id, channel) AS top
                  FROM dft)
            GROUP BY subject_id, window_id, channel, total)""",
    PEAKS_SQL, RR_SQL, HRV_SQL,
    """vote AS (SELECT subject_id, window_id, label FROM (
              SELECT subject_id, window_id, label,
                     row_number() OVER (PARTITION BY subject_id, window_id ORDER BY count(*) DESC, label) AS r
              FROM sig4_win GROUP BY subject_id, window_id, label) WHERE r = 1)""",
    """per_channel AS (
         SELECT m.subject_id, m.window_id, m.channel, s.stat, s.v, s.digits FROM m
         JOIN c USING (subject_id, window_id, channel) JOIN spec USING (subject_id, window_id, channel),
         LATERAL (VALUES ('mean', mean, 7), ('std', std, 4), ('min', mn, 4), ('max', mx, 4), ('median', median, 6),
                         ('iqr', q3 - q1, 6),
                         ('skew', CASE WHEN mn = mx THEN 0 ELSE m3 / power(std, 3) END, 5),
                         ('kurtosis', CASE WHEN mn = mx THEN -3 ELSE m4 / power(std, 4) - 3 END, 5),
                         ('dom_freq', dom, 4), ('spectral_energy', log2(1 + energy), 6),
                         ('spectral_entropy', entropy, 6)) AS s(stat, v, digits))""",
    """hrv_long AS (
         SELECT w.subject_id, w.window_id, 'ECG' AS channel, s.stat, s.v, 6 AS digits
         FROM (SELECT DISTINCT subject_id, window_id FROM sig4_win) w LEFT JOIN hrv USING (subject_id, window_id),
         LATERAL (VALUES ('hrv_rmssd', coalesce(rmssd, 0)), ('hrv_sdnn', coalesce(sdnn, 0)), ('hrv_mean_rr', coalesce(mean_rr, 0)),
                         ('hrv_pnn50', coalesce(pnn50, 0)), ('hrv_hr', coalesce(60000.0 / mean_rr, 0))) AS s(stat, v))""",
    "allf AS (SELECT * FROM per_channel UNION ALL SELECT * FROM hrv_long)",
]


def sig4_vectors(spark, sf_dir):
    return features.window_features(
        B.sig4_pos(spark, sf_dir), B.SIG4_SPEC, B.SIG4_CHANNELS, B.SIG_FS, ecg="extendedprice",
    )


def sig4_feature_names():
    from sensorloom.schema import feature_names
    return feature_names(B.SIG4_CHANNELS)


@query("win_feature_vector", with_ctes(_VECTOR_CTES, """
SELECT a.subject_id, a.window_id, v.label, channel || '_' || stat AS feature,
       CASE digits WHEN 4 THEN round(a.v, 4) WHEN 5 THEN round(a.v, 5) WHEN 6 THEN round(a.v, 6) ELSE round(a.v, 7) END AS value
FROM allf a JOIN vote v USING (subject_id, window_id)"""))
def win_feature_vector(spark, sf_dir):
    """Long form of the vectors; energies are compared on a log scale."""
    names = sig4_feature_names()
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("features").alias("value"))
    df = sig4_vectors(spark, sf_dir).select("subject_id", "window_id", "label", F.inline_outer(pairs).alias("feature", "value"))
    ends = {"_mean": 7, "_std": 4, "_min": 4, "_max": 4, "_skew": 5, "_kurtosis": 5, "_dom_freq": 4}
    value = F.when(F.col("feature").endswith("_spectral_energy"), F.round(F.log2(1 + F.col("value")), 6))
    value = value.when(F.col("feature").startswith("ECG_"), F.round("value", 6))
    for end, digits in ends.items():
        value = value.when(F.col("feature").endswith(end), F.round("value", digits))
    return df.select("subject_id", "window_id", "label", "feature", value.otherwise(F.round("value", 6)).alias("value"))
