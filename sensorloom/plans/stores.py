"""Queries on sources, sinks and keyed stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.operators import history
from sensorloom.plans import bindings as B
from sensorloom.plans.projections import RESULT_BODY, RESULT_SQL, sig_results
from sensorloom.plans.registry import query, with_ctes
from sensorloom.schema import HISTORY_CAP
from sensorloom.session import shared_dir
from sensorloom.sources import recordings, snapshots, stores


@query("src_validate", with_ctes([B.SIG_SQL], """
SELECT subject_id, array_to_string([s FOR s IN ['error', 'click', 'view', 'purchase', 'signup'] IF NOT list_contains(seen, s)], ',') AS missing
FROM (SELECT user_id AS subject_id, list(DISTINCT event_type) AS seen FROM events GROUP BY user_id)"""))
def src_validate(spark, sf_dir):
    """Which event kinds does a user lack?"""
    events = B.table(spark, sf_dir, "events").select(F.col("user_id").alias("subject_id"), F.col("event_type").alias("sensor"))
    out = recordings.missing_sensors(events, ["error", "click", "view", "purchase", "signup"])
    return out.select("subject_id", F.array_join("missing", ",").alias("missing"))


ALL_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


@query("src_multi", "SELECT subject_id, n FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS subject_id, count(*) AS n FROM {t}" for t in ALL_TABLES) + ")")
def src_multi(spark, sf_dir):
    """Scan a folder of recordings; the id is the file stem."""
    df = recordings.read_directory(spark, sf_dir, schema="l_orderkey long")
    return df.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))


@query("src_feature_cache", with_ctes([B.FEAT_SQL], """
SELECT subject_id, vec_id, label, round(features[1], 6) AS first_value, len(features) AS width FROM feat"""))
def src_feature_cache(spark, sf_dir):
    """Round trip through the partitioned cache, one subject replaced on the way."""
    feat = B.feat(spark, sf_dir)
    path = shared_dir(spark, "features")
    stores.save_features(feat, path)
    stores.save_features(feat.where("subject_id = 'S3'"), path)
    back = stores.load_features(spark, path, schema=feat.schema)
    return back.select("subject_id", "vec_id", "label", F.round(F.get("features", F.lit(0)), 6).alias("first_value"), F.size("features").cast("long").alias("width"))


_DOCS = """doc AS (SELECT tracking_id, captured_at, seq, stress_ratio, predicted_label,
  row_number() OVER (PARTITION BY tracking_id ORDER BY captured_at DESC, seq DESC) AS r, max(captured_at) OVER () AS top FROM hist)"""


def _versions(spark, sf_dir):
    """History rows as result documents; the version is time, then entry number."""
    df = B.hist(spark, sf_dir)
    version = F.struct("captured_at", "seq")
    return df, stores.document(df, "tracking_id", version, ["seq", "stress_ratio", "predicted_label"])


@query("src_result_upsert", with_ctes([B.HIST_SQL, _DOCS], """
SELECT tracking_id, seq, stress_ratio, predicted_label FROM doc WHERE r = 1
AND tracking_id NOT IN (SELECT tracking_id FROM hist WHERE seq % 50 = 0)"""))
def src_result_upsert(spark, sf_dir):
    """Newest document per key after some keys were deleted."""
    df, versions = _versions(spark, sf_dir)
    late = F.struct(F.lit("9999-01-01").cast("timestamp_ntz").alias("captured_at"), F.lit(0).cast("long").alias("seq"))
    gone = stores.tombstones(df.where("seq % 50 = 0").select("tracking_id").distinct(), late, "tracking_id")
    live = stores.current(versions.unionByName(gone), "tracking_id")
    return stores.decode(live, "seq long, stress_ratio double, predicted_label string", "tracking_id").drop("version")


@query("src_comparison_ttl", with_ctes([B.HIST_SQL, _DOCS], """
SELECT tracking_id, seq, CASE WHEN captured_at >= TIMESTAMP '2000-01-01' - INTERVAL 90 DAY THEN 'memory' ELSE 'store' END AS served_from
FROM doc WHERE r = 1"""))
def src_comparison_ttl(spark, sf_dir):
    df = B.hist(spark, sf_dir)
    newest = history.newest(df, 1)
    docs = stores.document(newest, "tracking_id", F.col("captured_at"), ["seq"])
    out = stores.comparison(docs, F.lit("2000-01-01").cast("timestamp"), 90 * 86400, "tracking_id")
    return stores.decode(out, "seq long", "tracking_id").select("tracking_id", "seq", "served_from")


@query("src_history_append", with_ctes([B.HIST_SQL], """
SELECT tracking_id, seq, stress_ratio FROM (
  SELECT *, row_number() OVER (PARTITION BY tracking_id ORDER BY captured_at DESC, seq DESC) AS r,
         count(*) FILTER (seq % 10 = 0) OVER (PARTITION BY tracking_id) > 0 AS touched FROM hist)
WHERE r <= 6 OR NOT touched"""))
def src_history_append(spark, sf_dir):
    """Append a tenth of the entries to the rest with a cap of six per touched id."""
    df = B.hist(spark, sf_dir)
    out = history.append(df.where("seq % 10 <> 0"), df.where("seq % 10 = 0"), cap=6)
    return out.select("tracking_id", "seq", "stress_ratio")


@query("src_history_by_id", with_ctes([B.HIST_SQL], """
SELECT tracking_id, seq, strftime(captured_at, '%Y-%m-%d') AS day, stress_ratio FROM (
  SELECT *, row_number() OVER (PARTITION BY tracking_id ORDER BY captured_at DESC, seq DESC) AS r FROM hist
  WHERE tracking_id = (SELECT tracking_id FROM hist GROUP BY tracking_id ORDER BY count(*) DESC, tracking_id LIMIT 1))
WHERE r <= 500 AND captured_at BETWEEN TIMESTAMP '1996-03-17 00:00:00' AND TIMESTAMP '1998-03-17 23:59:59'"""))
def src_history_by_id(spark, sf_dir):
    """Of the id with the most entries the newest entries up to the cap, of these the ones within bounds, from a bucketed table under snapshots: its bucket's files are opened."""
    df, root = B.hist(spark, sf_dir), shared_dir(spark, "by-id")
    snapshots.append(df.where("seq % 10 <> 0"), root, 0, buckets=8, days=365)
    snapshots.append(df.where("seq % 10 = 0"), root, 1)
    top = df.groupBy("tracking_id").count().orderBy(F.desc("count"), "tracking_id").first()["tracking_id"]
    found = snapshots.read(spark, root, HISTORY_CAP, top, "1996-03-17T00:00:00", "1998-03-17T23:59:59")
    return found.select("tracking_id", "seq", F.date_format("captured_at", "yyyy-MM-dd").alias("day"), "stress_ratio")


@query("src_history_csv", with_ctes([B.HIST_SQL], """
SELECT tracking_id, strftime(captured_at, '%Y-%m-%dT%H:%M:%SZ') AS captured_at, subject_id, 'manual input' AS method,
       CASE WHEN is_manual THEN 'True' ELSE 'False' END AS is_manual, stress_ratio, 'n/a' AS stress_level,
       CASE WHEN stress_ratio > 0.3 THEN 'True' ELSE 'False' END AS overall_stress, predicted_label, 1 AS total_windows,
       '{"' || predicted_label || '":1}' AS label_counts FROM hist"""))
def src_history_csv(spark, sf_dir):
    df = B.hist(spark, sf_dir).withColumns({
        "captured_at": F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "method": F.lit("manual input"), "stress_level": F.lit("n/a"),
        "overall_stress": F.col("stress_ratio") > 0.3, "total_windows": F.lit(1),
        "label_counts": F.create_map("predicted_label", F.lit(1))})
    return history.csv_frame(df)


@query("src_batch_results", with_ctes([*B.SIG_LABEL_CTES, RESULT_SQL], f"""
SELECT subject_id, '{{"method":"pre-trained","total_windows":' || total_windows || ',"label_counts":' || label_counts
       || ',"predicted_label":"' || predicted_label || '","stress_level":"' || stress_level || '"}}' AS data FROM ({RESULT_BODY})"""))
def src_batch_results(spark, sf_dir):
    """One JSON document per subject."""
    cols = ["method", "total_windows", "label_counts", "predicted_label", "stress_level"]
    return stores.document(sig_results(spark, sf_dir), "subject_id", F.lit(0), cols).select("subject_id", "data")


@query("src_catalog", with_ctes([B.FEAT_SQL], """
SELECT subject_id, bool_or(vec_id % 3 = 0) AS has_model, bool_or(vec_id % 101 = 0) AS has_cache FROM feat
WHERE subject_id NOT IN ('general', 'general_manual') GROUP BY subject_id"""))
def src_catalog(spark, sf_dir):
    df = B.feat(spark, sf_dir).select("subject_id", "vec_id")
    return stores.saved_files(stores.subjects_with_models(df), df.where("vec_id % 3 = 0"), df.where("vec_id % 101 = 0"))


@query("src_delete_cascade", with_ctes([B.HIST_SQL], """
SELECT tracking_id, seq, 'history' AS kind FROM hist WHERE tracking_id NOT IN (SELECT tracking_id FROM hist WHERE stress_ratio > 0.99)
UNION ALL SELECT tracking_id, max(seq), 'result' FROM hist WHERE tracking_id NOT IN (SELECT tracking_id FROM hist WHERE stress_ratio > 0.99)
GROUP BY tracking_id"""))
def src_delete_cascade(spark, sf_dir):
    df = B.hist(spark, sf_dir).select("tracking_id", "seq", "stress_ratio")
    doomed = df.where("stress_ratio > 0.99")
    latest = df.groupBy("tracking_id").agg(F.max("seq").alias("seq"))
    left = stores.delete_cascade(doomed, {"history": df.select("tracking_id", "seq"), "result": latest}, "tracking_id")
    parts = [rows.withColumn("kind", F.lit(name)) for name, rows in left.items()]
    return parts[0].unionByName(parts[1])
