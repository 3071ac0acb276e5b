"""Queries on metrics, summaries, ranking, splits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom import schema
from sensorloom.functions import labels as L
from sensorloom.functions import text
from sensorloom.operators import history, importance, metrics, results, scaling, sets, splits, windows
from sensorloom.plans import bindings as B
from sensorloom.plans.registry import query, with_ctes

NAME_SQL = "CASE {c} WHEN 1 THEN 'Baseline' WHEN 2 THEN 'Stress' ELSE 'Amusement' END"


@query("agg_class_dist", with_ctes([B.SIG_SQL], """
SELECT label, CASE label WHEN 1 THEN 'Baseline' WHEN 2 THEN 'Stress' WHEN 3 THEN 'Amusement' ELSE 'Unknown(0)' END AS label_name,
       count(*) AS n FROM sig GROUP BY label"""))
def agg_class_dist(spark, sf_dir):
    counts = B.sig(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("label", L.label_name(F.col("label")).alias("label_name"), "n")


@query("agg_distinct_labels", with_ctes([B.SIG_SQL], "SELECT DISTINCT label FROM sig WHERE label IN (1, 2, 3)"))
def agg_distinct_labels(spark, sf_dir):
    return B.sig(spark, sf_dir, valid_only=True).select("label").distinct().orderBy("label")


@query("agg_label_counts", with_ctes(B.SIG_LABEL_CTES, """
SELECT subject_id, '{' || concat_ws(',', CASE WHEN a > 0 THEN '"Baseline":' || a END, CASE WHEN b > 0 THEN '"Stress":' || b END,
                                    CASE WHEN c > 0 THEN '"Amusement":' || c END) || '}' AS label_counts
FROM (SELECT subject_id, count(*) FILTER (label = 1) AS a, count(*) FILTER (label = 2) AS b, count(*) FILTER (label = 3) AS c
      FROM sig_label GROUP BY subject_id)"""))
def agg_label_counts(spark, sf_dir):
    counts = {n: F.count_if(F.col("label") == c) for c, n in schema.LABEL_NAMES.items()}
    return sig_labels(spark, sf_dir).groupBy("subject_id").agg(F.to_json(results.counts_map(counts)).alias("label_counts"))


def sig_labels(spark, sf_dir):
    """Majority label of every window, by panes."""
    return windows.pane_label_windows(B.sig_pos(spark, sf_dir), B.SIG_SPEC, list(schema.LABEL_NAMES)).drop("n_samples")


@query("agg_label_share", with_ctes(B.SIG_LABEL_CTES, f"""
SELECT subject_id, label, {NAME_SQL.format(c='label')} AS label_name, lower({NAME_SQL.format(c='label')}) AS css, n,
       round(n * 100.0 / sum(n) OVER (PARTITION BY subject_id) + 0.0001, 1) AS share
FROM (SELECT subject_id, label, count(*) AS n FROM sig_label GROUP BY subject_id, label)"""))
def agg_label_share(spark, sf_dir):
    df = results.class_share(sig_labels(spark, sf_dir), keys=["subject_id"])
    name = L.label_name(F.col("label"))
    return df.select("subject_id", "label", name.alias("label_name"), text.css_slug(name).alias("css"), "n",
                     F.round(F.col("share") + 0.0001, 1).alias("share"))


@query("agg_stress_ratio", with_ctes(B.SIG_LABEL_CTES, """
SELECT subject_id, round(coalesce(count(*) FILTER (label = 2) / nullif(count(*) FILTER (label IN (1, 2)), 0), 0), 6) AS stress_ratio
FROM sig_label GROUP BY subject_id"""))
def agg_stress_ratio(spark, sf_dir):
    ratio = L.stress_ratio(F.count_if(L.is_stressed(F.col("label"))), F.count_if(L.is_baseline(F.col("label"))))
    return sig_labels(spark, sf_dir).groupBy("subject_id").agg(F.round(ratio, 6).alias("stress_ratio"))


@query("agg_totals", with_ctes(B.SIG_LABEL_CTES, """
SELECT count(*) AS n_subjects, CAST(sum(n) AS BIGINT) AS n_windows_total, max(n) AS most_windows
FROM (SELECT subject_id, count(*) AS n FROM sig_label GROUP BY subject_id)"""))
def agg_totals(spark, sf_dir):
    """The window count of a subject follows from its sample count, so no window is built."""
    per = B.sig(spark, sf_dir, valid_only=True).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))
    wins = per.select(B.SIG_SPEC.count(F.col("n")).alias("w")).where("w > 0")
    return wins.agg(F.count(F.lit(1)).alias("n_subjects"), F.sum("w").alias("n_windows_total"), F.max("w").alias("most_windows"))


@query("agg_class_weight_bal", with_ctes([B.FEAT_SQL], """
SELECT label, n, round(sum(n) OVER () / (n * count(*) OVER ()), 6) AS weight FROM (SELECT label, count(*) AS n FROM feat GROUP BY label)"""))
def agg_class_weight_bal(spark, sf_dir):
    return scaling.class_weights(B.feat(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query("agg_class_weight_inv", with_ctes([B.FEAT_SQL], """
SELECT label, n, round(sum(n) OVER () / n, 6) AS weight FROM (SELECT label, count(*) AS n FROM feat GROUP BY label)"""))
def agg_class_weight_inv(spark, sf_dir):
    return scaling.class_weights(B.feat(spark, sf_dir), balanced=False).withColumn("weight", F.round("weight", 6))


_FEAT_LONG = "long AS (SELECT vec_id, label, unnest(features) AS v, generate_subscripts(features, 1) - 1 AS pos FROM feat)"


def _long(df, digits=6):
    out = df.select("vec_id", F.posexplode("features").alias("pos", "value"))
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("value", digits).alias("value"))


@query("agg_standardize", with_ctes([B.FEAT_SQL, _FEAT_LONG, "s AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS sd FROM long GROUP BY pos)"], """
SELECT vec_id, pos, round(CASE WHEN sd = 0 THEN 0 ELSE (v - m) / sd END, 6) AS value FROM long JOIN s USING (pos)"""))
def agg_standardize(spark, sf_dir):
    return _long(scaling.standardize(B.feat(spark, sf_dir)))


@query("agg_impute_const", with_ctes([B.FEAT_SQL, _FEAT_LONG], """
SELECT vec_id, pos, CASE WHEN v < 0 THEN 0 ELSE v END AS value FROM long"""))
def agg_impute_const(spark, sf_dir):
    gaps = F.transform("features", lambda v, i: F.when((v < 0) & (i % 2 == 0), float("nan")).when(v >= 0, v))
    df = scaling.impute_vector(B.feat(spark, sf_dir).withColumn("features", gaps))
    out = df.select("vec_id", F.posexplode("features").alias("pos", "value"))
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), "value")


CONF_SQL = "conf AS (SELECT actual, predicted, count(*) AS n FROM pred GROUP BY actual, predicted)"
GRID_SQL = """grid AS (SELECT a.l AS actual, p.l AS predicted, coalesce(conf.n, 0) AS n
  FROM (SELECT actual AS l FROM pred UNION SELECT predicted FROM pred) a
  JOIN (SELECT actual AS l FROM pred UNION SELECT predicted FROM pred) p ON true
  LEFT JOIN conf ON conf.actual = a.l AND conf.predicted = p.l)"""


@query("agg_confusion", with_ctes([*B.PRED_CTES, CONF_SQL, GRID_SQL], "SELECT actual, predicted, n FROM grid"))
def agg_confusion(spark, sf_dir):
    return metrics.confusion_grid(metrics.confusion(B.pred(spark, sf_dir)))


@query("agg_confusion_norm", with_ctes([*B.PRED_CTES, CONF_SQL, GRID_SQL], """
SELECT actual, predicted, round(n / max(n) OVER (), 6) AS shade FROM grid"""))
def agg_confusion_norm(spark, sf_dir):
    grid = metrics.confusion_shade(metrics.confusion_grid(metrics.confusion(B.pred(spark, sf_dir))))
    return grid.select("actual", "predicted", F.round("shade", 6).alias("shade"))


@query("agg_accuracy", with_ctes(B.PRED_CTES, """
SELECT subject_id, round(avg(CASE WHEN actual = predicted THEN 1 ELSE 0 END), 6) AS accuracy FROM pred GROUP BY subject_id"""))
def agg_accuracy(spark, sf_dir):
    hit = F.when(F.col("actual") == F.col("predicted"), 1).otherwise(0)
    return B.pred(spark, sf_dir).groupBy("subject_id").agg(F.round(F.avg(hit), 6).alias("accuracy"))


def _scores_sql(key: str) -> list[str]:
    """Per-class and overall scores by key, written with joins."""
    k = f"{key}, " if key else ""
    return [
        f"cls AS (SELECT {k}l AS label, sum(s) AS support, sum(g) AS guessed, sum(t) AS tp FROM ("
        f"SELECT {k}actual AS l, 1 AS s, 0 AS g, CASE WHEN actual = predicted THEN 1 ELSE 0 END AS t FROM pred UNION ALL "
        f"SELECT {k}predicted, 0, 1, 0 FROM pred) GROUP BY {k}l)",
        "prf AS (SELECT *, coalesce(tp / nullif(guessed, 0), 0) AS prec, coalesce(tp / nullif(support, 0), 0) AS rec, "
        "coalesce(2 * tp / nullif(guessed + support, 0), 0) AS f1 FROM cls)",
        f"tot AS (SELECT {k}sum(tp) / sum(support) AS accuracy, sum(f1 * support) / sum(support) AS f1_weighted, avg(f1) AS f1_macro, "
        "sum(prec * support) / sum(support) AS wprec, sum(rec * support) / sum(support) AS wrec, CAST(sum(support) AS BIGINT) AS n, "
        f"avg(prec) AS mprec, avg(rec) AS mrec FROM prf {'GROUP BY ' + key if key else ''})",
    ]


@query("agg_prf", with_ctes([*B.PRED_CTES, *_scores_sql("subject_id")], """
SELECT subject_id, round(accuracy, 6) AS accuracy, round(f1_weighted, 6) AS f1_weighted, round(f1_macro, 6) AS f1_macro,
       round(wprec, 6) AS "precision", round(wrec, 6) AS recall, n FROM tot"""))
def agg_prf(spark, sf_dir):
    per = metrics.class_scores(metrics.confusion(B.pred(spark, sf_dir), ["subject_id"]), ["subject_id"])
    df = metrics.overall_scores(per, ["subject_id"])
    return df.select("subject_id", *[F.round(c, 6).alias(c) for c in ("accuracy", "f1_weighted", "f1_macro", "precision", "recall")], "n")


@query("agg_class_report", with_ctes([*B.PRED_CTES, *_scores_sql("")], f"""
SELECT {NAME_SQL.format(c='label')} AS "row", round(prec, 6) AS "precision", round(rec, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM prf
UNION ALL SELECT 'accuracy', NULL, NULL, round(accuracy, 6), n FROM tot
UNION ALL SELECT 'macro avg', round(mprec, 6), round(mrec, 6), round(f1_macro, 6), n FROM tot
UNION ALL SELECT 'weighted avg', round(wprec, 6), round(wrec, 6), round(f1_weighted, 6), n FROM tot"""))
def agg_class_report(spark, sf_dir):
    df = metrics.report(metrics.confusion(B.pred(spark, sf_dir)))
    return df.select("row", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


_AUC_SQL = """ranked AS (
  SELECT c.l AS label, actual = c.l AS hit,
         rank() OVER (PARTITION BY c.l ORDER BY score) + (count(*) OVER (PARTITION BY c.l, score) - 1) / 2.0 AS r
  FROM pred JOIN (SELECT DISTINCT actual AS l FROM pred) c ON true),
per AS (SELECT label, count(*) FILTER (hit) AS np, count(*) FILTER (NOT hit) AS nn, sum(r) FILTER (hit) AS s FROM ranked GROUP BY label)"""


@query("agg_roc_auc", with_ctes([*B.PRED_CTES, _AUC_SQL, B.DOCL_SQL], """
SELECT 'three classes' AS kind, round(sum((s - np * (np + 1) / 2.0) / (np * nn) * np) / sum(np), 6) AS roc_auc FROM per
UNION ALL
SELECT 'two classes', round((sum(r) FILTER (quality = 1) - any_value(np) * (any_value(np) + 1) / 2.0) / (any_value(np) * any_value(nn)), 6)
FROM (SELECT *, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r,
             count(*) FILTER (quality = 1) OVER () AS np, count(*) FILTER (quality = 0) OVER () AS nn FROM docl)"""))
def agg_roc_auc(spark, sf_dir):
    three = metrics.roc_auc(B.pred(spark, sf_dir), {c: "score" for c in schema.LABEL_NAMES})
    two = metrics.roc_auc(B.docl(spark, sf_dir).withColumnRenamed("quality", "actual"), {0: "n_chars", 1: "n_chars"})
    both = three.select(F.lit("three classes").alias("kind"), "roc_auc").unionByName(two.select(F.lit("two classes").alias("kind"), "roc_auc"))
    return both.select("kind", F.round("roc_auc", 6).alias("roc_auc"))


def _feat_guess(spark, sf_dir):
    """A fixed rule as the classifier: the position of the largest feature."""
    guess = (F.array_position("features", F.array_max("features")) % 3 + 1).cast("int")
    return B.feat(spark, sf_dir).select("vec_id", "subject_id", F.col("label").alias("actual"), guess.alias("predicted"))


_GUESS_SQL = """pred AS (SELECT vec_id, subject_id, label AS actual,
                  CAST(list_position(features, list_max(features)) % 3 + 1 AS INTEGER) AS predicted FROM feat)"""


@query("agg_cv_summary", with_ctes([B.FEAT_SQL, _GUESS_SQL], """
SELECT round(avg(a), 6) AS cv_mean, round(stddev_pop(a), 6) AS cv_std, count(*) AS folds
FROM (SELECT vec_id % 5 AS fold, avg(CASE WHEN actual = predicted THEN 1 ELSE 0 END) AS a FROM pred GROUP BY vec_id % 5)"""))
def agg_cv_summary(spark, sf_dir):
    hit = F.when(F.col("actual") == F.col("predicted"), 1).otherwise(0)
    folds = _feat_guess(spark, sf_dir).groupBy((F.col("vec_id") % 5).alias("fold")).agg(F.avg(hit).alias("accuracy"))
    return metrics.fold_summary(folds).select(F.round("cv_mean", 6).alias("cv_mean"), F.round("cv_std", 6).alias("cv_std"), "folds")


@query("agg_loso_summary", with_ctes([B.FEAT_SQL, _GUESS_SQL, *_scores_sql("subject_id")], """
SELECT subject_id, round(accuracy, 6) AS accuracy, round(f1_weighted, 6) AS f1_weighted, n AS n_windows FROM tot
UNION ALL SELECT 'all', round(avg(accuracy), 6), round(stddev_pop(accuracy), 6), CAST(sum(n) AS BIGINT) FROM tot"""))
def agg_loso_summary(spark, sf_dir):
    """Per-subject rows, then one row with mean and deviation of the accuracies."""
    per = metrics.loso_scores(_feat_guess(spark, sf_dir))
    total = metrics.loso_summary(per).select(
        F.lit("all").alias("subject_id"), F.col("loso_mean_accuracy").alias("accuracy"),
        F.col("loso_std_accuracy").alias("f1_weighted"), F.col("n_windows_total").alias("n_windows"))
    return per.unionByName(total).select(
        "subject_id", F.round("accuracy", 6).alias("accuracy"), F.round("f1_weighted", 6).alias("f1_weighted"), "n_windows")


_LAST_TWO = """lag_ AS (SELECT *, row_number() OVER (PARTITION BY tracking_id ORDER BY captured_at DESC, seq DESC) AS r,
                      lag(stress_ratio) OVER (PARTITION BY tracking_id ORDER BY captured_at, seq) AS prev FROM hist)"""


@query("agg_history_summary", with_ctes([B.HIST_SQL, _LAST_TWO], """
SELECT tracking_id, n AS "count", stress_ratio AS latest, prev AS previous, round(stress_ratio - prev, 4) AS delta,
       CASE WHEN round(stress_ratio - prev, 4) > 0.02 THEN 'up' WHEN round(stress_ratio - prev, 4) < -0.02 THEN 'down' ELSE 'stable' END AS trend
FROM lag_ JOIN (SELECT tracking_id, count(*) AS n FROM hist GROUP BY tracking_id) USING (tracking_id) WHERE r = 1"""))
def agg_history_summary(spark, sf_dir):
    return history.summary(B.hist(spark, sf_dir))


@query("agg_mean_std_gate", with_ctes([B.FEAT_SQL, _FEAT_LONG,
    "s AS (SELECT pos, avg(v) * 0.7 + stddev_samp(v) * 1.3 AS g FROM long GROUP BY pos)",
    "gate AS (SELECT pos, 1 / (1 + exp(-(g - avg(g) OVER ()) / sqrt(var_pop(g) OVER () + 1e-5))) AS k FROM s)"], """
SELECT vec_id, pos, round(v * k, 6) AS value FROM long JOIN gate USING (pos)"""))
def agg_mean_std_gate(spark, sf_dir):
    return _long(scaling.recalibrate(B.feat(spark, sf_dir), 0.7, 1.3))


# --- Ordering and ranking ----------------------------------------------------------------------


@query("win_history_delta", with_ctes([B.HIST_SQL, _LAST_TWO], """
SELECT tracking_id, seq, stress_ratio, prev AS previous_ratio, round(stress_ratio - prev, 4) AS delta FROM lag_"""))
def win_history_delta(spark, sf_dir):
    return history.deltas(B.hist(spark, sf_dir)).select("tracking_id", "seq", "stress_ratio", "previous_ratio", "delta")


@query("win_cap_per_key", with_ctes([B.HIST_SQL, _LAST_TWO], "SELECT tracking_id, seq, stress_ratio FROM lag_ WHERE r <= 5"))
def win_cap_per_key(spark, sf_dir):
    return history.newest(B.hist(spark, sf_dir), 5).select("tracking_id", "seq", "stress_ratio")


_MODELS_SQL = """acc AS (SELECT subject_id // 7 AS subject_id, CAST(subject_id % 7 AS INTEGER) AS catalogue_idx,
                    round(avg(CASE WHEN actual = predicted THEN 1 ELSE 0 END), 6) AS a, count(*) AS n FROM pred GROUP BY ALL),
models AS (SELECT subject_id, catalogue_idx, CASE WHEN n < 45 THEN 0 ELSE a END AS accuracy,
                  CASE WHEN n < 45 THEN 'too few rows: ' || n END AS error FROM acc)"""


def _models(spark, sf_dir):
    """Seven 'classifiers' per subject from the forecast rows; short ones count as failed runs."""
    hit = F.when(F.col("actual") == F.col("predicted"), 1).otherwise(0)
    per = B.pred(spark, sf_dir).groupBy(
        F.floor(F.col("subject_id") / 7).alias("subject_id"), (F.col("subject_id") % 7).cast("int").alias("catalogue_idx"),
    ).agg(F.round(F.avg(hit), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    error = F.when(F.col("n") < 45, F.concat(F.lit("too few rows: "), F.col("n").cast("string")))
    return metrics.with_failures(per, error, ["accuracy"]).drop("n")


@query("win_rank_models", with_ctes([*B.PRED_CTES, _MODELS_SQL], """
SELECT *, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY accuracy DESC, catalogue_idx) AS INTEGER) AS rank,
       row_number() OVER (PARTITION BY subject_id ORDER BY accuracy DESC, catalogue_idx) = 1 AND error IS NULL AS is_best FROM models"""))
def win_rank_models(spark, sf_dir):
    return metrics.rank_models(_models(spark, sf_dir), ["subject_id"])


@query("topk_best", with_ctes([*B.PRED_CTES, _MODELS_SQL], """
SELECT subject_id, catalogue_idx, accuracy FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY accuracy DESC, catalogue_idx) AS r FROM models) WHERE r = 1"""))
def topk_best(spark, sf_dir):
    return metrics.best_model(_models(spark, sf_dir), ["subject_id"], "catalogue_idx")


@query("prj_metric_unpivot", with_ctes([*B.PRED_CTES, *_scores_sql("subject_id"), """long AS (
  SELECT subject_id, m.metric, m.v FROM tot, LATERAL (VALUES ('accuracy', accuracy), ('f1_weighted', f1_weighted), ('f1_macro', f1_macro),
         ('precision', wprec), ('recall', wrec), ('roc_auc', NULL), ('cv_mean', accuracy / 2)) AS m(metric, v))"""], """
SELECT subject_id, metric, round(coalesce(v, 0) * 100, 4) AS percent FROM long"""))
def prj_metric_unpivot(spark, sf_dir):
    per = metrics.class_scores(metrics.confusion(B.pred(spark, sf_dir), ["subject_id"]), ["subject_id"])
    df = metrics.overall_scores(per, ["subject_id"]).withColumns({
        "roc_auc": F.lit(None).cast("double"), "cv_mean": F.col("accuracy") / 2})
    return metrics.metric_long(df, schema.METRIC_NAMES, ["subject_id"]).withColumn("percent", F.round("percent", 4))


@query("win_timeline", with_ctes(B.SIG_LABEL_CTES, """
SELECT subject_id, window_id // 8 AS chunk, string_agg(CAST(label AS VARCHAR), ',' ORDER BY window_id) AS labels
FROM sig_label GROUP BY subject_id, window_id // 8"""))
def win_timeline(spark, sf_dir):
    """Ordered labels in chunks of eight windows (the default chunk is larger)."""
    df = results.timeline(sig_labels(spark, sf_dir), prediction="label", chunk=8)
    return df.select("subject_id", "chunk", F.array_join(F.transform("labels", lambda v: v.cast("string")), ",").alias("labels"))


@query("sort_natural", with_ctes([B.FEAT_SQL], """
SELECT subject_id, 'S' || lpad(CAST(length(subject_id) - 1 AS VARCHAR), 10, '0') || substr(subject_id, 2) AS natural_key FROM (SELECT DISTINCT subject_id FROM feat)"""))
def sort_natural(spark, sf_dir):
    ids = B.feat(spark, sf_dir).select("subject_id").distinct()
    return ids.withColumn("natural_key", F.array_join(text.natural_key(F.col("subject_id")), "")).orderBy("natural_key")


@query("topk_recent", with_ctes([B.HIST_SQL, _LAST_TWO], "SELECT tracking_id, seq, CAST(r AS INTEGER) AS rank FROM lag_ WHERE r <= 8"))
def topk_recent(spark, sf_dir):
    return history.newest(B.hist(spark, sf_dir), schema.RECENT_ENTRIES, rank="rank").select("tracking_id", "seq", "rank")


@query("topk_importance", with_ctes([B.FEAT_SQL, _FEAT_LONG,
    "v AS (SELECT pos, var_pop(v) AS var FROM long GROUP BY pos)"], """
SELECT pos, 'F' || pos AS feature, round(var / (SELECT sum(var) FROM v), 5) AS importance FROM v ORDER BY var DESC, pos LIMIT 15"""))
def topk_importance(spark, sf_dir):
    """Variance shares stand in for a model's importances; ml_importances feeds the same report."""
    var = F.transform("std_pop", lambda s: s * s)
    stats = scaling.vector_stats(B.feat(spark, sf_dir)).select(var.alias("v"))
    stats = stats.withColumn("total", F.aggregate("v", F.lit(0.0), lambda a, x: a + x))
    rows = stats.select("total", F.posexplode("v").alias("pos", "var")).select(
        F.col("pos").cast("long").alias("pos"), F.concat(F.lit("F"), F.col("pos").cast("string")).alias("feature"),
        (F.col("var") / F.col("total")).alias("importance"))
    return importance.top(rows)


# --- Splits ------------------------------------------------------------------------------------


def _digest(text: str) -> str:
    return f"substr(md5({text} || '|42'), 1, 15)"


@query("split_stratified", with_ctes([B.FEAT_SQL], f"""
SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_digest('vec_id')}, vec_id)
                      <= round(count(*) OVER (PARTITION BY label) * 0.2) AS is_test FROM feat"""))
def split_stratified(spark, sf_dir):
    return splits.stratified(B.feat(spark, sf_dir).select("vec_id", "label"), "label", ["vec_id"])


@query("split_kfold", with_ctes([B.FEAT_SQL], f"""
SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {_digest('vec_id')}, vec_id) - 1) % 5 AS INTEGER) AS fold FROM feat"""))
def split_kfold(spark, sf_dir):
    return splits.kfold(B.feat(spark, sf_dir).select("vec_id", "label"), "label", ["vec_id"])


@query("split_loso", with_ctes([B.FEAT_SQL], """
SELECT s.subject_id AS held_out, count(*) FILTER (f.subject_id <> s.subject_id) AS n_train, count(*) FILTER (f.subject_id = s.subject_id) AS n_test
FROM feat f JOIN (SELECT DISTINCT subject_id FROM feat) s ON true GROUP BY s.subject_id"""))
def split_loso(spark, sf_dir):
    """Fold sizes of leave-one-subject-out, from one count per subject."""
    counts = B.feat(spark, sf_dir).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_test"))
    total = counts.agg(F.sum("n_test")).scalar()
    return counts.select(F.col("subject_id").alias("held_out"), (total - F.col("n_test")).alias("n_train"), "n_test")


@query("split_random_mask", f"""
SELECT event_id, row_number() OVER (ORDER BY {_digest('event_id')}, event_id) <= floor(count(*) OVER () * 0.8) AS is_train FROM events""")
def split_random_mask(spark, sf_dir):
    return splits.random_mask(B.sig(spark, sf_dir).select("event_id"), ["event_id"])


# --- Set operations ----------------------------------------------------------------------------


@query("set_union_all", with_ctes(B.SIG_LABEL_CTES, """
SELECT subject_id, window_id, label FROM sig_label WHERE subject_id % 2 = 0
UNION ALL SELECT subject_id, window_id, label FROM sig_label WHERE subject_id % 2 = 1"""))
def set_union_all(spark, sf_dir):
    wins = sig_labels(spark, sf_dir)
    even, odd = wins.where("subject_id % 2 = 0"), wins.where("subject_id % 2 = 1")
    return sets.union_all(even, odd)


@query("set_union_distinct", with_ctes([B.HIST_SQL], """
SELECT tracking_id FROM hist WHERE is_manual UNION SELECT tracking_id FROM hist WHERE stress_ratio > 0.5"""))
def set_union_distinct(spark, sf_dir):
    df = B.hist(spark, sf_dir)
    return sets.union_distinct(df.where("is_manual").select("tracking_id"), df.where("stress_ratio > 0.5").select("tracking_id"))


@query("set_except", with_ctes([B.FEAT_SQL], """
SELECT subject_id FROM feat EXCEPT SELECT * FROM (VALUES ('S2'), ('S3'))"""))
def set_except(spark, sf_dir):
    df = B.feat(spark, sf_dir)
    general = df.where(F.col("subject_id").isin("S2", "S3")).select("subject_id")
    return sets.difference(df.select("subject_id"), general)


@query("set_edges_both_ways", with_ctes(B.SIG_CTES, """
SELECT subject_id, src, dst FROM (
  SELECT subject_id, pos AS src, pos + 1 AS dst FROM sig_pos WHERE pos + 1 < n
  UNION ALL SELECT subject_id, pos + 1, pos FROM sig_pos WHERE pos + 1 < n
  UNION ALL SELECT subject_id, pos, pos FROM sig_pos)"""))
def set_edges_both_ways(spark, sf_dir):
    from sensorloom.operators import graph

    nodes = B.sig_pos(spark, sf_dir).select("subject_id", "pos")
    chain = graph.chain_edges(nodes, ["subject_id"])
    return graph.add_self_loops(graph.both_ways(chain), nodes, ["subject_id"]).select("subject_id", "src", "dst")
