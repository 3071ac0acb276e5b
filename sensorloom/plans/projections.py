"""Queries on row-wise projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom import schema
from sensorloom.functions import bands, clean, text, vectors
from sensorloom.functions import labels as L
from sensorloom.operators import history, results, sensors, windows
from sensorloom.plans import bindings as B
from sensorloom.plans.registry import query, with_ctes

ROW = ["l_orderkey", "l_linenumber", "l_partkey"]
ROW_SQL = "l_orderkey, l_linenumber, l_partkey"
# The four test channels read as four known sensors.
SENSOR_OF = {"quantity": "Chest EDA", "extendedprice": "Wrist Acc X", "discount": "Wrist BVP", "tax": "Chest Acc Z"}


@query("prj_channels", with_ctes([B.SIG4_SQL], f"""
SELECT {ROW_SQL}, quantity AS "Chest Acc X", extendedprice AS "Chest Acc Y", discount AS "Chest Acc Z", tax AS "Chest EDA"
FROM sig4"""))
def prj_channels(spark, sf_dir):
    nested = B.sig4(spark, sf_dir).select(*ROW, F.array("quantity", "extendedprice", "discount").alias("ACC"), F.col("tax").alias("EDA"))
    return sensors.flatten_chest(nested, ROW)


@query("flt_valid_label", with_ctes([B.SIG_SQL], "SELECT subject_id, event_id, label, x FROM sig WHERE label IN (1, 2, 3)"))
def flt_valid_label(spark, sf_dir):
    samples = B.sig(spark, sf_dir, valid_only=True)
    return samples.where(L.is_valid(F.col("label"))).select("subject_id", "event_id", "label", "x")


def _dirty(spark, sf_dir):
    """Samples with gaps and overflows where tax or discount is at its end of scale."""
    x = (
        F.when(F.col("tax") == 0, float("inf")).when(F.col("tax") == 0.08, float("-inf"))
        .when(F.col("discount") == 0, float("nan")).when(F.col("discount") != 0.1, F.col("extendedprice"))
    )
    return B.sig4(spark, sf_dir).select(*ROW, x.alias("x"))


_DIRTY = """dirty AS (SELECT *, CASE WHEN tax = 0 THEN 'inf'::DOUBLE WHEN tax = 0.08 THEN '-inf'::DOUBLE
                  WHEN discount = 0 THEN 'nan'::DOUBLE WHEN discount <> 0.1 THEN extendedprice END AS x FROM sig4)"""


@query("prj_sanitize_raw", with_ctes([B.SIG4_SQL, _DIRTY], f"""
SELECT {ROW_SQL}, CASE WHEN x IS NULL OR isnan(x) THEN 0 WHEN x = 'inf'::DOUBLE THEN 3.4028234663852886e38
                       WHEN x = '-inf'::DOUBLE THEN -3.4028234663852886e38 ELSE x END AS x FROM dirty"""))
def prj_sanitize_raw(spark, sf_dir):
    return _dirty(spark, sf_dir).select(*ROW, clean.sanitize_raw(F.col("x")).alias("x"))


@query("prj_sanitize_feat", with_ctes([B.FEAT_SQL], """
SELECT vec_id, i - 1 AS pos, CASE WHEN v > 0.25 OR v < -0.25 OR abs(v) < 0.01 THEN 0 ELSE v END AS value
FROM (SELECT vec_id, unnest(features) AS v, generate_subscripts(features, 1) AS i FROM feat)"""))
def prj_sanitize_feat(spark, sf_dir):
    spoilt = F.transform("features", lambda v: (
        F.when(v > 0.25, float("inf")).when(v < -0.25, float("-inf")).when(F.abs(v) < 0.01, float("nan")).otherwise(v)
    ))
    df = B.feat(spark, sf_dir).select("vec_id", F.posexplode(clean.sanitize_features(spoilt)).alias("pos", "value"))
    return df.select("vec_id", F.col("pos").cast("long").alias("pos"), "value")


@query("prj_cast", with_ctes([B.SIG4_SQL], f"""
SELECT {ROW_SQL}, CAST(quantity AS FLOAT) AS quantity, CAST(extendedprice AS FLOAT) AS extendedprice,
       CAST(discount AS FLOAT) AS discount, CAST(tax AS FLOAT) AS tax, CAST(label AS BIGINT) AS label FROM sig4"""))
def prj_cast(spark, sf_dir):
    return B.sig4(spark, sf_dir).select(
        *ROW, *[F.col(c).cast("float").alias(c) for c in B.SIG4_CHANNELS], F.col("label").cast("long").alias("label"))


@query("prj_label_recode", with_ctes([B.SIG_SQL], """
SELECT event_id, CASE WHEN label + 5 = 7 THEN 5 ELSE label + 5 END AS label FROM sig"""))
def prj_label_recode(spark, sf_dir):
    return B.sig(spark, sf_dir).select("event_id", L.recode(F.col("label") + 5).alias("label"))


@query("prj_label_name", with_ctes([B.SIG_SQL], """
SELECT event_id, label, CASE label WHEN 1 THEN 'Baseline' WHEN 2 THEN 'Stress' WHEN 3 THEN 'Amusement'
                                   ELSE 'Unknown(' || label || ')' END AS label_name FROM sig"""))
def prj_label_name(spark, sf_dir):
    return B.sig(spark, sf_dir).select("event_id", "label", L.label_name(F.col("label")).alias("label_name"))


@query("prj_is_stressed", with_ctes([B.SIG_SQL], "SELECT event_id, label = 2 AS is_stressed FROM sig"))
def prj_is_stressed(spark, sf_dir):
    return B.sig(spark, sf_dir).select("event_id", L.is_stressed(F.col("label")).alias("is_stressed"))


@query("flt_named_only", with_ctes([B.SIG_SQL], """
SELECT event_id, label AS prediction, CASE label WHEN 1 THEN 'Baseline' WHEN 2 THEN 'Stress' ELSE 'Amusement' END AS label_name
FROM sig WHERE label IN (1, 2, 3)"""))
def flt_named_only(spark, sf_dir):
    df = B.sig(spark, sf_dir, valid_only=True).withColumnRenamed("label", "prediction")
    return results.named_only(df).select("event_id", "prediction", L.label_name(F.col("prediction")).alias("label_name"))


_BAND_SQL = """CASE WHEN is_manual THEN CASE WHEN stress_ratio < 0.35 THEN 'Low Stress' WHEN stress_ratio < 0.5 THEN 'Moderate Stress'
                    WHEN stress_ratio < 0.75 THEN 'High Stress' ELSE 'Critical Stress' END
     ELSE CASE WHEN stress_ratio < 0.2 THEN 'Low Stress' WHEN stress_ratio < 0.4 THEN 'Moderate Stress'
                    WHEN stress_ratio < 0.65 THEN 'High Stress' ELSE 'Critical Stress' END END"""


@query("prj_stress_band", with_ctes([B.HIST_SQL], f"""
SELECT seq, stress_level,
       CASE stress_level WHEN 'Low Stress' THEN '#34d399' WHEN 'Moderate Stress' THEN '#fbbf24'
            WHEN 'High Stress' THEN CASE WHEN is_manual THEN '#fbbf24' ELSE '#f87171' END ELSE '#dc2626' END AS stress_level_color,
       'gauge-' || lower(replace(stress_level, ' Stress', '')) AS gauge_class
FROM (SELECT *, {_BAND_SQL} AS stress_level FROM hist)"""))
def prj_stress_band(spark, sf_dir):
    df = B.hist(spark, sf_dir)
    return df.select("seq", bands.stress_band(F.col("stress_ratio"), F.col("is_manual")).alias("b")).select("seq", "b.*")


@query("prj_verdict", with_ctes([B.HIST_SQL], f"""
SELECT seq, CASE WHEN is_manual THEN predicted_label = 'Stress' ELSE stress_ratio > 0.3 END AS overall_stress,
       CASE WHEN is_manual AND predicted_label <> 'Stress' THEN 'Low Stress' ELSE {_BAND_SQL} END AS stress_level
FROM hist"""))
def prj_verdict(spark, sf_dir):
    ratio, manual, stressed = F.col("stress_ratio"), F.col("is_manual"), F.col("predicted_label") == "Stress"
    return B.hist(spark, sf_dir).select(
        "seq", bands.overall_stress(ratio, manual, stressed).alias("overall_stress"),
        bands.verdict_band(ratio, manual, stressed)["stress_level"].alias("stress_level"))


def sig_predictions(spark, sf_dir):
    """Window labels as predictions, with a window-level confidence of stress."""
    wins = windows.aggregate(
        B.sig_pos(spark, sf_dir), B.SIG_SPEC,
        [windows.majority(F.col("label")).alias("prediction"), F.avg((F.col("label") == 2).cast("double")).alias("confidence")],
    )
    return wins.drop("n_samples")


RESULT_SQL = """res AS (
  SELECT subject_id, count(*) AS total_windows, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS n1,
         sum(CASE WHEN label = 2 THEN 1 ELSE 0 END) AS n2, sum(CASE WHEN label = 3 THEN 1 ELSE 0 END) AS n3,
         arg_min(label, window_id) AS first_label,
         max(conf) AS conf
  FROM sig_label JOIN (SELECT subject_id, window_id, avg(CASE WHEN label = 2 THEN 1.0 ELSE 0.0 END) AS conf
                       FROM sig_win GROUP BY subject_id, window_id) USING (subject_id, window_id)
  GROUP BY subject_id),
doc AS (
  SELECT subject_id, total_windows, first_label,
         CASE WHEN total_windows = 1 THEN conf ELSE coalesce(n2 / nullif(n1 + n2, 0), 0) END AS stress_ratio,
         total_windows = 1 AS is_manual,
         '{' || concat_ws(',', CASE WHEN n1 > 0 THEN '"Baseline":' || n1 END, CASE WHEN n2 > 0 THEN '"Stress":' || n2 END,
                          CASE WHEN n3 > 0 THEN '"Amusement":' || n3 END) || '}' AS label_counts,
         CASE first_label WHEN 1 THEN 'Baseline' WHEN 2 THEN 'Stress' ELSE 'Amusement' END AS predicted_label
  FROM res)"""

RESULT_BODY = f"""SELECT subject_id, 'pre-trained' AS method, total_windows, label_counts, round(stress_ratio, 6) AS stress_ratio,
       CASE WHEN is_manual THEN first_label = 2 ELSE stress_ratio > 0.3 END AS overall_stress, predicted_label,
       5 AS window_sec, is_manual,
       CASE WHEN is_manual AND first_label <> 2 THEN 'Low Stress' ELSE {_BAND_SQL} END AS stress_level
FROM doc"""


def sig_results(spark, sf_dir):
    return results.summarise(sig_predictions(spark, sf_dir), "pre-trained", confidence="confidence")


@query("prj_result_doc", with_ctes([*B.SIG_LABEL_CTES, RESULT_SQL], RESULT_BODY))
def prj_result_doc(spark, sf_dir):
    """The summary part of a result; its label sequence is win_timeline."""
    return sig_results(spark, sf_dir).select(
        "subject_id", "method", "total_windows", F.to_json("label_counts").alias("label_counts"),
        F.round("stress_ratio", 6).alias("stress_ratio"), "overall_stress", "predicted_label", "window_sec", "is_manual", "stress_level")


@query("prj_history_entry", with_ctes([*B.SIG_LABEL_CTES, RESULT_SQL], f"""
SELECT 'T' || subject_id AS tracking_id, subject_id, method, is_manual, stress_ratio, stress_level, overall_stress,
       predicted_label, total_windows, label_counts FROM ({RESULT_BODY})"""))
def prj_history_entry(spark, sf_dir):
    df = results.history_entry(sig_results(spark, sf_dir), F.concat(F.lit("T"), F.col("subject_id").cast("string")))
    return df.drop("captured_at").withColumn("label_counts", F.to_json("label_counts")).withColumn("stress_ratio", F.round("stress_ratio", 6))


@query("prj_tracking_id", """
SELECT c_custkey, raw, regexp_replace(regexp_replace(
         regexp_replace(regexp_replace(replace(trim(raw), '/', ' '), '^\\s+|\\s+$', '', 'g'), '\\s+', '_', 'g'),
         '[^A-Za-z0-9_.-]', '', 'g'), '^[._]+|[._]+$', '', 'g') AS tracking_id
FROM (SELECT c_custkey, '  ../' || c_name || ' / ' || c_mktsegment || '. ' AS raw FROM customer)""")
def prj_tracking_id(spark, sf_dir):
    raw = F.concat(F.lit("  ../"), F.col("c_name"), F.lit(" / "), F.col("c_mktsegment"), F.lit(". "))
    return B.table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"), text.tracking_id(raw).alias("tracking_id"))


@query("prj_sensor_coerce", """
SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k,
       coalesce(try_cast(event_type AS DOUBLE), 0) AS bad, 0.0::DOUBLE AS missing FROM events""")
def prj_sensor_coerce(spark, sf_dir):
    df = B.table(spark, sf_dir, "events").select("event_id", F.map_concat(
        F.from_json("props", "map<string,string>"), F.create_map(F.lit("bad"), F.col("event_type"))).alias("m"))
    return df.select("event_id", *[clean.sensor_value(F.col("m"), s).alias(s) for s in ("k", "bad", "missing")])


@query("prj_sensor_band", with_ctes([B.SIG4_SQL, """long AS (
  SELECT subject_id, 'Chest EDA' AS sensor, quantity AS value, 6.0 AS high, 7.0 AS critical FROM sig4
  UNION ALL SELECT subject_id, 'Wrist Acc X', extendedprice, 17.3, 19.0 FROM sig4
  UNION ALL SELECT subject_id, 'Wrist BVP', discount, 0.018, 0.025 FROM sig4
  UNION ALL SELECT subject_id, 'Chest Acc Z', tax, -0.266, -0.20 FROM sig4)"""], """
SELECT subject_id, sensor, CASE WHEN critical <> 0 AND value >= critical THEN 'critical'
       WHEN high <> 0 AND value >= high THEN 'stress' ELSE 'baseline' END AS band, count(*) AS n
FROM long GROUP BY ALL"""))
def prj_sensor_band(spark, sf_dir):
    wide = B.sig4(spark, sf_dir).select("subject_id", *[F.col(c).alias(s) for c, s in SENSOR_OF.items()])
    long = sensors.to_long(wide, ["subject_id"], list(SENSOR_OF.values()), "sensor", "value")
    judged = sensors.with_band(long, schema.sensor_dim(spark))
    return judged.groupBy("subject_id", "sensor", "band").agg(F.count(F.lit(1)).alias("n"))


@query("prj_sensor_presets", with_ctes([B.SIG4_SQL, """c AS (
  SELECT label, avg(quantity) AS quantity, avg(extendedprice) AS extendedprice, avg(discount) AS discount, avg(tax) AS tax
  FROM sig4 GROUP BY label),
p AS (SELECT 'low' AS scenario, * EXCLUDE label FROM c WHERE label = 1
      UNION ALL SELECT 'high', * EXCLUDE label FROM c WHERE label = 2
      UNION ALL SELECT 'critical', h.quantity + (h.quantity - l.quantity) / 2, h.extendedprice + (h.extendedprice - l.extendedprice) / 2,
                h.discount + (h.discount - l.discount) / 2, h.tax + (h.tax - l.tax) / 2
      FROM c h JOIN c l ON h.label = 2 AND l.label = 1)"""], """
SELECT scenario, round(quantity, 6) AS quantity, round(extendedprice, 4) AS extendedprice, round(discount, 8) AS discount, round(tax, 8) AS tax
FROM p"""))
def prj_sensor_presets(spark, sf_dir):
    """Scenario rows of a threshold dimension that comes from the labelled samples themselves."""
    dim = sensors.dim_from_samples(B.sig4(spark, sf_dir), B.SIG4_CHANNELS)
    wide = sensors.preset_rows(sensors.presets(dim), B.SIG4_CHANNELS)
    digits = {"quantity": 6, "extendedprice": 4, "discount": 8, "tax": 8}
    return wide.select("scenario", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("flt_history_range", with_ctes([B.HIST_SQL], """
SELECT tracking_id, seq, strftime(captured_at, '%Y-%m-%d') AS day, stress_ratio FROM hist
WHERE captured_at BETWEEN TIMESTAMP '1996-03-17 00:00:00' AND TIMESTAMP '1998-03-17 23:59:59'"""))
def flt_history_range(spark, sf_dir):
    df = history.in_range(B.hist(spark, sf_dir), start="1996-03-17T00:00:00", end="1998-03-17T23:59:59")
    return df.select("tracking_id", "seq", F.date_format("captured_at", "yyyy-MM-dd").alias("day"), "stress_ratio")


@query("prj_iso_bounds", with_ctes([B.HIST_SQL], """
SELECT seq, strftime(captured_at + INTERVAL 7 HOUR + INTERVAL (seq % 60) MINUTE, '%Y-%m-%dT%H:%M:%S.') || '000Z' AS range_start,
       strftime(captured_at + INTERVAL 7 HOUR + INTERVAL (seq % 60) MINUTE + INTERVAL 59 SECOND, '%Y-%m-%dT%H:%M:%S.') || '999Z' AS range_end
FROM hist"""))
def prj_iso_bounds(spark, sf_dir):
    minute = F.lpad((F.col("seq") % 60).cast("string"), 2, "0")
    local = F.concat(F.date_format("captured_at", "yyyy-MM-dd"), F.lit("T07:"), minute)
    shown = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    return B.hist(spark, sf_dir).select(
        "seq", F.date_format(text.history_bound(local), shown).alias("range_start"),
        F.date_format(text.history_bound(local, is_end=True), shown).alias("range_end"))


_EXPLODED = "(SELECT vec_id, unnest({v}) AS value, generate_subscripts({v}, 1) - 1 AS pos FROM feat)"


def _explode(df, vector):
    out = df.select("vec_id", F.posexplode(vector).alias("pos", "value"))
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), "value")


@query("prj_truncate_features", with_ctes([B.FEAT_SQL], "SELECT * FROM " + _EXPLODED.format(v="features[1:40]")))
def prj_truncate_features(spark, sf_dir):
    return _explode(B.feat(spark, sf_dir), vectors.truncate(F.col("features"), 40))


@query("flt_stale_model", with_ctes([B.FEAT_SQL], """
SELECT subject_id, sum(len(features)) AS n_features FROM feat GROUP BY subject_id HAVING sum(len(features)) >= 2176"""))
def flt_stale_model(spark, sf_dir):
    from sensorloom.sources.models import fresh_models

    registry = B.feat(spark, sf_dir).groupBy("subject_id").agg(F.sum(F.size("features")).alias("n_features"))
    return fresh_models(registry, min_features=2176)


@query("prj_means_only", with_ctes([B.FEAT_SQL], "SELECT * FROM " + _EXPLODED.format(v="features[1:14]")))
def prj_means_only(spark, sf_dir):
    return _explode(B.feat(spark, sf_dir), vectors.means_only(F.col("features")))


@query("prj_manual_synth", with_ctes([B.SIG4_SQL, """v AS (
  SELECT [quantity, -extendedprice, discount, tax] AS m FROM sig4),
f AS (SELECT [(abs(x) + 1e-6) * 0.08::DOUBLE FOR x IN m] AS sd, [(abs(x) + 1e-6) * 0.07::DOUBLE FOR x IN m] AS iq,
             [x * 0.9::DOUBLE FOR x IN m] AS lo, [x * 1.1::DOUBLE FOR x IN m] AS hi, m,
             [0.0::DOUBLE, 0, 0, 0] AS z FROM v),
w AS (SELECT m || sd || lo || hi || m || iq || z || z || z || z || z || [30.0::DOUBLE, 50, 800, 20, 75] AS vec FROM f)"""], """
SELECT pos, count(*) AS n, round(min(value), 9) AS lowest, round(max(value), 9) AS highest, round(avg(value), 4) AS mean
FROM (SELECT unnest(vec) AS value, generate_subscripts(vec, 1) - 1 AS pos FROM w) GROUP BY pos"""))
def prj_manual_synth(spark, sf_dir):
    """Vectors of all readings; negated prices keep the min-above-max case of negative readings."""
    readings = [F.col("quantity"), -F.col("extendedprice"), F.col("discount"), F.col("tax")]
    made = B.sig4(spark, sf_dir).select(F.posexplode(vectors.manual_vector(readings)).alias("pos", "value"))
    return made.groupBy(F.col("pos").cast("long").alias("pos")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("value"), 9).alias("lowest"),
        F.round(F.max("value"), 9).alias("highest"), F.round(F.avg("value"), 4).alias("mean"))


@query("prj_channel_groups", with_ctes([B.FEAT_SQL], """
SELECT vec_id, pos // 8 AS channel_group, count(*) AS width, max(value) AS top FROM
""" + _EXPLODED.format(v="features") + " GROUP BY vec_id, pos // 8"))
def prj_channel_groups(spark, sf_dir):
    groups = vectors.channel_groups(F.col("features"), [8] * 8)
    df = B.feat(spark, sf_dir).select("vec_id", F.posexplode(groups).alias("g", "v"))
    return df.select("vec_id", F.col("g").cast("long").alias("channel_group"), F.size("v").cast("long").alias("width"), F.array_max("v").alias("top"))


@query("prj_feature_names", with_ctes([B.FEAT_SQL], """
SELECT vec_id, pos, 'F' || pos AS feature, value FROM """ + _EXPLODED.format(v="features") + """
UNION ALL
SELECT vec_id, pos, [""" + ", ".join(f"'{n}'" for n in schema.feature_names()[:64]) + """][pos + 1], value FROM """ + _EXPLODED.format(v="features")))
def prj_feature_names(spark, sf_dir):
    """Long form: positional names where the width does not fit, real names where it does."""
    names = schema.feature_names()
    df = B.feat(spark, sf_dir)
    both = df.select("vec_id", F.inline(vectors.named(F.col("features"), names))).unionByName(
        df.select("vec_id", F.inline(vectors.named(F.col("features"), names[:64]))))
    return both.select("vec_id", F.col("pos").cast("long").alias("pos"), "feature", "value")


_STORED = """stored AS (SELECT *, CASE WHEN seq % 7 = 0 THEN '' ELSE '{"' || predicted_label || '":' || (seq % 5 + 1) || '}' END AS lc FROM hist)"""


@query("prj_history_decode", with_ctes([B.HIST_SQL, _STORED], """
SELECT seq, is_manual, stress_ratio > 0.3 AS overall_stress, CASE WHEN lc = '' THEN 0 ELSE 1 END AS n_labels,
       CASE WHEN lc <> '' THEN seq % 5 + 1 END AS first_count FROM stored"""))
def prj_history_decode(spark, sf_dir):
    text_map = F.when(F.col("seq") % 7 == 0, "").otherwise(F.concat(
        F.lit('{"'), "predicted_label", F.lit('":'), (F.col("seq") % 5 + 1).cast("string"), F.lit("}")))
    stored = B.hist(spark, sf_dir).withColumns({
        "is_manual": F.col("is_manual").cast("int"), "overall_stress": (F.col("stress_ratio") > 0.3).cast("int"), "label_counts": text_map})
    return history.decode(stored).select(
        "seq", "is_manual", "overall_stress", F.size("label_counts").alias("n_labels"),
        F.try_element_at(F.map_values("label_counts"), F.lit(1)).alias("first_count"))


@query("prj_score_band", with_ctes([B.HIST_SQL], """
SELECT seq, CASE WHEN stress_ratio > 0.4 THEN 'red' WHEN stress_ratio > 0.2 THEN 'orange' ELSE 'green' END AS colour FROM hist"""))
def prj_score_band(spark, sf_dir):
    return B.hist(spark, sf_dir).select("seq", bands.score_band(F.col("stress_ratio")).alias("colour"))


@query("prj_percent", with_ctes([B.HIST_SQL], """
SELECT seq, round((seq % 997) / 1024.0 * 100, 1) AS pct1, round((seq % 997) / 1024.0 * 100, 2) AS pct2,
       printf('%.1f%%', (seq % 997) / 1024.0 * 100 + 0.01) AS shown,
       CASE WHEN seq % 11 = 0 THEN 'No previous entry yet'
            ELSE CASE WHEN seq % 2001 > 1000 THEN '+' ELSE '' END || printf('%.1f', (seq % 2001 - 1000) / 1000.0 * 100) || '% vs previous entry' END AS delta_shown
FROM hist"""))
def prj_percent(spark, sf_dir):
    share = (F.col("seq") % 997) / 1024.0
    delta = F.when(F.col("seq") % 11 != 0, (F.col("seq") % 2001 - 1000) / 1000.0)
    return B.hist(spark, sf_dir).select(
        "seq", text.percent(share, 1).alias("pct1"), text.percent(share, 2).alias("pct2"),
        text.percent_text(share + 0.0001, 1).alias("shown"), text.delta_text(delta).alias("delta_shown"))


@query("flt_eval_classes", with_ctes(B.PRED_CTES, """
SELECT event_id, CASE actual WHEN 1 THEN 'Baseline' ELSE 'Stress' END AS actual_name,
       CASE predicted WHEN 1 THEN 'Baseline' WHEN 2 THEN 'Stress' ELSE 'Other' END AS predicted_name
FROM pred WHERE actual IN (1, 2)"""))
def flt_eval_classes(spark, sf_dir):
    from sensorloom.operators.metrics import eval_rows

    names = {1: "Baseline", 2: "Stress"}
    return eval_rows(B.pred(spark, sf_dir), names).select("event_id", "actual_name", "predicted_name")
