"""Queries on classifiers, at the catalogue's parameters and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions import labels as L
from sensorloom.operators import graph, importance, knn, knn_join, learn, metrics, scaling, splits
from sensorloom.plans import bindings as B
from sensorloom.plans.graphs import KEYS, nodes_and_edges
from sensorloom.plans.registry import query, with_ctes
from sensorloom.session import shared_dir

def _scored(spark, sf_dir, name):
    """Fit on the training part, score the test part."""
    feat = B.feat(spark, sf_dir)
    parted = splits.stratified(feat, "label", ["vec_id"])
    model = learn.fit(parted.where("NOT is_test"), name)
    out = model.score(parted.where("is_test"), "vec_id")
    return out.select("vec_id", "label", "prediction", F.transform("probability", lambda p: F.round(p, 6)).alias("probability"))


@query("ml_rf")
def ml_rf(spark, sf_dir):
    return _scored(spark, sf_dir, "Random Forest")


@query("ml_svm")
def ml_svm(spark, sf_dir):
    return _scored(spark, sf_dir, "SVM")


@query("ml_tree")
def ml_tree(spark, sf_dir):
    return _scored(spark, sf_dir, "Decision Tree")


@query("ml_gbt")
def ml_gbt(spark, sf_dir):
    return _scored(spark, sf_dir, "Gradient Boosting")


@query("ml_logreg")
def ml_logreg(spark, sf_dir):
    return _scored(spark, sf_dir, "Logistic Regression")


@query("ml_gbt_sub")
def ml_gbt_sub(spark, sf_dir):
    return _scored(spark, sf_dir, "LightGBM")


@query("ml_knn", with_ctes([B.FEAT_SQL, """near AS (
  SELECT q.vec_id, t.vec_id AS tid, t.label, list_distance([x * 0.5 FOR x IN q.features], t.features) AS d,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance([x * 0.5 FOR x IN q.features], t.features), t.vec_id) AS r
  FROM feat q JOIN feat t ON true),
w AS (SELECT vec_id, label, CASE WHEN min(d) OVER (PARTITION BY vec_id) = 0 THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END ELSE 1 / d END AS w
      FROM near WHERE r <= 5),
p AS (SELECT vec_id, label, sum(w) AS w FROM w GROUP BY vec_id, label)"""], """
SELECT vec_id, arg_max(label, w) AS prediction, round(coalesce(sum(w) FILTER (label = 2), 0) / sum(w), 6) AS p_stress FROM p GROUP BY vec_id"""))
def ml_knn(spark, sf_dir):
    """Every vector, halved, against all vectors, or the first ``knn.MAX_TRAIN_ROWS`` in a hash order. The SQL compares all: it agrees up to that many."""
    feat = B.feat(spark, sf_dir)
    halved = feat.select("vec_id", F.transform("features", lambda v: v * 0.5).alias("features"))
    votes = halved.select("vec_id", knn.judge(feat, F.col("features"), 5, [1, 2, 3]).alias("v"))
    return votes.select("vec_id", "v.prediction", F.round(F.get("v.probability", F.lit(1)), 6).alias("p_stress"))


@query("ml_knn_join", with_ctes([B.FEAT_SQL, """near AS (
  SELECT q.vec_id AS qid, t.vec_id AS tid, t.label, list_distance([x * 0.5 FOR x IN q.features], t.features) AS d,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance([x * 0.5 FOR x IN q.features], t.features), t.vec_id) AS r
  FROM feat q JOIN feat t ON true)"""], "SELECT qid, r AS \"rank\", tid, label, round(d, 6) AS distance FROM near WHERE r <= 5"))
def ml_knn_join(spark, sf_dir):
    """The five nearest of all vectors to every vector, halved, by the exact join, whatever the number of training rows."""
    feat = B.feat(spark, sf_dir)
    halved = feat.select("vec_id", F.transform("features", lambda v: v * 0.5).alias("features"))
    found = knn_join.neighbours(feat, halved, 5)
    return found.select("qid", "rank", "tid", "label", F.round("distance", 6).alias("distance"))


_CENTROID_SQL = with_ctes([B.FEAT_SQL,
    "long AS (SELECT vec_id, label, unnest(features) AS v, generate_subscripts(features, 1) - 1 AS pos FROM feat)",
    "s AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS sd FROM long GROUP BY pos)"], """
SELECT label, pos, round(avg(CASE WHEN sd = 0 THEN 0 ELSE (v - m) / sd END), 6) AS centre, count(*) AS n
FROM long JOIN s USING (pos) GROUP BY label, pos""")


@query("ml_scaled_fit", _CENTROID_SQL)
def ml_scaled_fit(spark, sf_dir):
    """Impute and standardise stages of a fitted classifier, as class centroids of what it sees."""
    feat = B.feat(spark, sf_dir)
    model = learn.fit(feat, "Decision Tree")
    seen = learn._vectors(feat)
    for stage in model.pipeline.stages[:2]:
        seen = stage.transform(seen)
    from pyspark.ml.functions import vector_to_array

    long = seen.select("label", F.posexplode(vector_to_array("scaled")).alias("pos", "v"))
    out = long.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg("v"), 6).alias("centre"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("centre", F.col("centre") + 0.0)


@query("ml_feature_select")
def ml_feature_select(spark, sf_dir):
    kept = learn.select_features(B.feat(spark, sf_dir))
    rows = learn._keep(B.feat(spark, sf_dir), kept)
    return rows.select("vec_id", F.size("features").alias("n_kept"), F.array_max("features").alias("largest"))


@query("ml_train_eval")
def ml_train_eval(spark, sf_dir):
    """The binary binding: quality of documents from simple text figures."""
    docs = B.table(spark, sf_dir, "documents").join(B.table(spark, sf_dir, "labels"), "doc_id")
    length = F.length("text").cast("double")
    letters = F.length(F.regexp_replace("text", "[^A-Za-z]", "")).cast("double")
    rows = docs.select("doc_id", (F.col("quality") + 1).alias("label"), F.array(length, letters / F.greatest(length, F.lit(1.0)), F.size(F.split("text", "\n")).cast("double")).alias("features"))
    _, row, _ = learn.train_eval(rows, "Logistic Regression", row_id="doc_id")
    return row


@query("ml_compare")
def ml_compare(spark, sf_dir):
    return learn.compare(B.feat(spark, sf_dir))


@query("ml_general")
def ml_general(spark, sf_dir):
    """Leave-one-subject-out scores of the pooled model, with the totals of the pooled fit."""
    feat = B.feat(spark, sf_dir)
    general = learn.train_general(feat)
    per = metrics.loso_scores(general.loso)
    accuracy = general.metrics.select("accuracy").scalar()
    manual = general.manual_metrics.select("accuracy").scalar()
    return per.withColumns({"pooled_accuracy": accuracy, "manual_model_accuracy": manual})


@query("ml_manual_model")
def ml_manual_model(spark, sf_dir):
    model, row = learn.train_manual(B.feat(spark, sf_dir))
    return row


@query("ml_predict")
def ml_predict(spark, sf_dir):
    feat = B.feat(spark, sf_dir)
    model = learn.fit(feat, "Decision Tree")
    out = learn.predict(model, feat, "vec_id")
    ratio = L.stress_ratio(F.count_if(L.is_stressed(F.col("prediction"))), F.count_if(L.is_baseline(F.col("prediction"))))
    return out.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"), F.round(ratio, 6).alias("stress_ratio"))


@query("ml_stress_confidence")
def ml_stress_confidence(spark, sf_dir):
    """Each vector is its own subject, so each gets a probability instead of a ratio."""
    feat = B.feat(spark, sf_dir).withColumn("subject_id", F.col("vec_id").cast("string"))
    model = learn.fit(feat, "Decision Tree")
    return learn.predict(model, feat, "vec_id").select("vec_id", "label_name", "is_stressed", F.round("stress_confidence", 6).alias("stress_confidence"))


@query("ml_importances")
def ml_importances(spark, sf_dir):
    model = learn.fit(B.feat(spark, sf_dir), "Random Forest")
    named = model.importances().withColumn("feature", F.concat(F.lit("F"), F.col("pos").cast("string")))
    return importance.top(named, 15)


@query("src_model_store", "SELECT vec_id, TRUE AS same FROM embeddings")
def src_model_store(spark, sf_dir):
    """Predictions of a stored and reloaded model beside those of the original."""
    feat = B.feat(spark, sf_dir)
    model = learn.fit(feat, "Decision Tree")
    root = shared_dir(spark, "models")
    learn.save(model, root, "general")
    again = learn.load(root, "general")
    a = model.score(feat, "vec_id").select("vec_id", F.col("prediction").alias("before"))
    b = again.score(feat, "vec_id").select("vec_id", F.col("prediction").alias("after"))
    return a.join(b, "vec_id").select("vec_id", (F.col("before") == F.col("after")).alias("same"))


@query("gr_node_classify")
def gr_node_classify(spark, sf_dir):
    """Nodes from propagated features: figures of the training and the test side."""
    nodes, edges = nodes_and_edges(spark, sf_dir)
    wide = nodes.select("subject_id", "pos", "x", (F.col("x") * F.col("x")).alias("x2"), F.pmod(F.col("pos"), F.lit(7)).cast("double").alias("phase7"))
    cols = ["x", "x2", "phase7"]
    spread = graph.propagate(wide, edges, KEYS, cols, [1.0, 1.0, 1.0])
    rows = spread.join(nodes.select("subject_id", "pos", "label"), ["subject_id", "pos"]).select(
        F.xxhash64("subject_id", "pos").alias("vec_id"), "label", F.array(*cols).alias("features"))
    from sensorloom.session import materialise

    masked = materialise(splits.random_mask(rows, ["vec_id"]), "nodes")
    model = learn.fit(masked.where("is_train"), "Logistic Regression")
    scored = model.score(masked, "vec_id").select("is_train", F.col("label").alias("actual"), F.col("prediction").alias("predicted"))
    return metrics.overall_scores(metrics.class_scores(metrics.confusion(scored, ["is_train"]), ["is_train"]), ["is_train"])
