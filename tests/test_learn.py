import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import boost, forest, knn, learn, metrics, svm

RNG = np.random.default_rng(11)
SMALL = {
    "Random Forest": {"trees": 8, "depth": 5}, "SVM": {"C": 10.0}, "Decision Tree": {"depth": 5},
    "Gradient Boosting": {"rounds": 3, "depth": 3}, "Logistic Regression": {"rounds": 50}, "LightGBM": {"rounds": 3, "depth": 3},
}


def blobs(spark, n=180, width=4, spread=0.8):
    y = np.arange(n) % 3 + 1
    x = RNG.normal(size=(n, width)) * spread
    x[np.arange(n), y - 1] += 3
    rows = [(i, f"S{i % 4}", [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "vec_id long, subject_id string, features array<double>, label int").repartition(4), x, y


def brute_knn(train, query, k):
    out = []
    for q in query:
        d = np.sqrt(((train - q) ** 2).sum(axis=1))
        out.append(sorted((float(v), i) for i, v in enumerate(d))[:k])
    return out


@pytest.mark.parametrize("cells", [4_000_000, 500])
def test_knn_is_exact(spark, cells, monkeypatch):
    """Clusters, many copies of one vector, few distances at a time: the same neighbours as all pairs."""
    monkeypatch.setattr(knn, "CELLS", cells)
    x = np.concatenate([RNG.normal(size=(70, 3)), RNG.normal(size=(40, 3)) * 0.01 + 4, np.tile([[1.0, 1.0, 1.0]], (60, 1)), np.round(RNG.normal(size=(30, 3)))])
    train = spark.createDataFrame([(i, [float(a) for a in v], i % 3 + 1) for i, v in enumerate(x)], "vec_id long, features array<double>, label int")
    q = np.concatenate([x[::9], RNG.normal(size=(20, 3)) * 2])
    queries = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(q)], "vec_id long, features array<double>")
    got = knn.neighbours(train, queries, 5)
    mine = {}
    for r in got.orderBy("qid", "rank").collect():
        mine.setdefault(r.qid, []).append((r.distance, r.tid))
    for i, want in enumerate(brute_knn(x, q, 5)):
        assert [t for _, t in mine[i]] == [t for _, t in want] and np.allclose([d for d, _ in mine[i]], [d for d, _ in want])


def test_knn_training_rows_are_bounded_by_a_parameter(spark):
    train = spark.createDataFrame([(i, [float(i)], 1) for i in range(50)], "vec_id long, features array<double>, label int")
    got = knn.training(train, most=20)
    assert len(got.tid) == 20 and list(got.tid) == sorted(got.tid) and list(knn.training(train, most=20).tid) == list(got.tid)


def test_votes_keep_to_the_bound(spark):
    rows = [(i, [float(i)], i % 3 + 1) for i in range(50)]
    train = spark.createDataFrame(rows, "vec_id long, features array<double>, label int")
    known = set(knn.training(train, most=20).tid)
    got = {r.vec_id: r.v.prediction for r in train.select("vec_id", knn.judge(train, F.col("features"), 1, [1, 2, 3], most=20).alias("v")).collect()}
    want = {}
    for i, _, _ in rows:
        near = min(abs(i - j) for j in known)
        want[i] = {j % 3 + 1 for j in known if abs(i - j) == near}
    assert all(got[i] in want[i] for i in want) and any(got[i] != i % 3 + 1 for i in want)
    fitted = learn.fit(train, "KNN", {"k": 1, "most": 20})
    assert {r.vec_id: r.prediction for r in fitted.score(train, "vec_id").collect()} == got


def test_vote(spark):
    rows = [(1, 0.0, 7, 2), (1, 0.0, 8, 3), (1, 0.1, 9, 1), (2, 1.0, 1, 1), (2, 0.5, 2, 3), (2, 1.0, 3, 1), (3, 2.0, 4, 3)]
    found = spark.createDataFrame(rows, "qid long, distance double, tid long, label int")
    got = {r.qid: (r.prediction, r.probability) for r in knn.vote(found, [1, 2, 3]).collect()}
    assert got[1] == (2, [0.0, 0.5, 0.5]) and got[2] == (1, [0.5, 0.0, 0.5]) and got[3][0] == 3


@pytest.mark.parametrize("name", list(learn.CATALOGUE))
def test_classifier_learns_scores_and_reloads(spark, tmp_path, name):
    df, _, y = blobs(spark)
    model = learn.fit(df, name, SMALL.get(name))
    scored = learn.predict(model, df, "vec_id").orderBy("vec_id").collect()
    assert np.mean([r.prediction == c for r, c in zip(scored, y)]) > 0.85
    for r in scored:
        assert len(r.probability) == 3 and math.isclose(sum(r.probability), 1.0, abs_tol=1e-9) and r.stress_confidence is None
        assert r.is_stressed == (r.prediction == 2)
    learn.save(model, str(tmp_path), "m")
    again = learn.load(str(tmp_path), "m").score(df, "vec_id").orderBy("vec_id").collect()
    assert [r.prediction for r in again] == [r.prediction for r in scored]
    assert np.allclose([r.probability for r in again], [r.probability for r in scored])


def test_scaling_uses_population_deviation(spark):
    df, x, _ = blobs(spark, 30)
    model = learn.fit(df, "Decision Tree", {"depth": 2})
    seen = learn._vectors(df)
    for stage in model.pipeline.stages[:2]:
        seen = stage.transform(seen)
    got = np.array([r.scaled.toArray() for r in seen.orderBy("vec_id").collect()])
    assert np.allclose(got, (x - x.mean(axis=0)) / x.std(axis=0))


def test_logistic_loss_is_at_its_minimum(spark):
    """The gradient of the published objective (C times weighted loss plus half the squared norm) vanishes."""
    df, x, y = blobs(spark, 120, spread=2.0)
    df = df.where("label <> 3 or vec_id < 60")
    keep = (y != 3) | (np.arange(120) < 60)
    x, y = x[keep], y[keep]
    model = learn.fit(df, "Logistic Regression", {"rounds": 500})
    lr = model.pipeline.stages[-1]
    w, b = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    p = np.exp(z @ w.T + b)
    p /= p.sum(axis=1, keepdims=True)
    weight = np.array([len(y) / (3 * (y == c).sum()) for c in y])
    grad = ((p - np.eye(3)[y - 1]) * weight[:, None]).T @ z + w
    assert np.abs(grad).max() < 0.05


def test_train_eval_compare_and_general(spark):
    df, _, _ = blobs(spark)
    model, row, scored = learn.train_eval(df, "no such classifier", SMALL["Random Forest"], cv_folds=2)
    r = row.first()
    assert model.name == "Random Forest" and scored.count() == 36 and r.n == 36
    for c in ("accuracy", "f1_weighted", "f1_macro", "precision", "recall", "roc_auc", "cv_mean"):
        assert 0.6 < r[c] <= 1.0
    names = ["Decision Tree", "Logistic Regression", "KNN"]
    table = learn.compare(df, names, {**SMALL, "KNN": {"k": "oops"}}, cv_folds=0).orderBy("rank").collect()
    assert len(table) == 3 and table[-1].classifier_name == "KNN" and table[-1].error and table[-1].accuracy == 0.0
    assert table[0].is_best and table[0].accuracy >= table[1].accuracy
    g = learn.train_general(df, "Decision Tree", SMALL["Decision Tree"], cv_folds=0, n_channels=2, manual_params={"trees": 4, "depth": 4})
    m = g.metrics.first()
    assert (m.n_subjects, m.n_windows_total) == (4, 180) and g.manual.width == 2
    assert metrics.loso_summary(metrics.loso_scores(g.loso)).first().loso_mean_accuracy > 0.7
    two = learn.train_general(df.where("subject_id in ('S0', 'S1')"), "Decision Tree", SMALL["Decision Tree"], cv_folds=0, n_channels=2,
                              manual_params={"trees": 3, "depth": 3})
    assert two.loso is None


def test_feature_selection_keeps_all_when_few_matter(spark):
    df, _, _ = blobs(spark)
    assert learn.select_features(df, {"trees": 5, "depth": 4}) == [0, 1, 2, 3]
    kept = learn.select_features(df, {"trees": 20, "depth": 5, "min_kept": 1})
    assert set(kept) <= {0, 1, 2, 3} and {0, 1, 2} & set(kept)


def test_single_row_gets_a_probability(spark):
    df, _, _ = blobs(spark)
    model = learn.fit(df, "Logistic Regression", SMALL["Logistic Regression"])
    one = df.where("vec_id = 1").withColumn("subject_id", F.lit("lone"))
    r = learn.predict(model, one, "vec_id").first()
    assert r.stress_confidence == pytest.approx(r.probability[1])
    wide = df.withColumn("features", F.concat("features", F.array(F.lit(9.0), F.lit(float("nan")))))
    a = [x.prediction for x in model.score(wide, "vec_id").orderBy("vec_id").collect()]
    assert a == [x.prediction for x in model.score(df, "vec_id").orderBy("vec_id").collect()]


@pytest.mark.parametrize("name", ["Random Forest", "SVM", "Gradient Boosting", "KNN"])
def test_models_come_from_all_rows(spark, name, monkeypatch):
    """Bounds of a sample that nobody asked for change nothing, in a single fit and in those of folds."""
    df, _, _ = blobs(spark, 150, spread=2.0)
    whole = {r.vec_id: r.probability for r in learn.fit(df, name, SMALL.get(name)).score(df, "vec_id").collect()}
    folds = learn.cross_validate(df, name, SMALL.get(name), 3).orderBy("fold").collect()
    monkeypatch.setattr(boost, "MAX_CELLS", 80)
    monkeypatch.setattr(knn, "MAX_TRAIN_ROWS", 20)
    again = {r.vec_id: r.probability for r in learn.fit(df, name, SMALL.get(name)).score(df, "vec_id").collect()}
    assert all(np.allclose(again[i], whole[i]) for i in whole)
    assert learn.cross_validate(df, name, SMALL.get(name), 3).orderBy("fold").collect() == folds


@pytest.mark.parametrize("name", ["Random Forest", "SVM"])
def test_models_that_grow_stay_off_the_driver(spark, name, monkeypatch):
    """Repeated and null ids are scored row by row, and neither trees nor support vectors are fetched."""
    df, _, y = blobs(spark, 60)
    odd = df.withColumn("vec_id", F.when(F.col("vec_id") >= 6, F.col("vec_id") % 5))
    for module in (forest, svm):
        monkeypatch.setattr(module, "fetched", lambda *a: pytest.fail("the model came to the driver"))
    model = learn.fit(df, name, SMALL[name])
    got = model.score(odd.withColumn("was", F.col("label")), "vec_id").collect()
    assert len(got) == 60 and sum(r.vec_id is None for r in got) == 6 and np.mean([r.prediction == r.was for r in got]) > 0.85
    if name == "Random Forest":
        assert sum(r.importance for r in model.importances().collect()) == pytest.approx(1)


def test_models_score_streams_as_they_score_tables(spark, tmp_path):
    from sensorloom.streaming import run

    df, _, _ = blobs(spark, 60)
    df.coalesce(1).write.parquet(str(tmp_path / "rows"))
    for name in ("Random Forest", "SVM"):
        model = learn.fit(df, name, SMALL[name])
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "rows"))
        got = run.drain(model.score(stream, "vec_id").select("vec_id", "prediction", "probability"), f"t-{name[:3]}")
        want = {r.vec_id: r for r in model.score(df, "vec_id").collect()}
        assert all(r.prediction == want[r.vec_id].prediction and np.allclose(r.probability, want[r.vec_id].probability) for r in got.collect())
