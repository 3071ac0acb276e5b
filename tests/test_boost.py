"""Softmax boosting against a plain version without histograms, and many models in one job against separate fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import boost, learn

DEEP = {"rounds": 200, "depth": 5, "rate": 0.1}
BEST = {"rounds": 12, "depth": 8, "leaves": 63, "rate": 0.1}


def rows_of(n, width, seed=3, shift=1.2):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 3
    x = rng.normal(size=(n, width))
    x[np.arange(n), y] += shift
    x[:, -1] = np.round(x[:, -1])  # ties
    return x.astype(np.float32), y


def plain_booster(x, y, classes, rounds, depth, rate, leaves=10**9, min_leaf=1):
    """Every split is searched in the rows themselves; all leaves are looked at for the best one each time."""
    edges = boost.bin_edges(x)
    n, scores = len(y), np.log(np.tile(np.bincount(y) / len(y), (len(y), 1)))
    sizes = []

    def split_of(rows, g, h):
        best = (0.0, None, None)
        whole = g[rows].sum() ** 2 / h[rows].sum()
        for f in range(x.shape[1]):
            for border in edges[f]:
                left = rows[x[rows, f] <= border]
                right = rows[x[rows, f] > border]
                if min(len(left), len(right)) < min_leaf or min(h[left].sum(), h[right].sum()) <= 1e-6:
                    continue
                gain = g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - whole
                if round(gain, 12) > round(best[0], 12):
                    best = (gain, f, border)
        return best

    for _ in range(rounds):
        p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
        for k in range(classes):
            g, h = (y == k) - p[:, k], p[:, k] * (1 - p[:, k])
            tree = [(np.arange(n), 0, split_of(np.arange(n), g, h))]
            while len(tree) < leaves:
                ready = [t for t in tree if t[1] < depth and t[2][0] > 1e-12]
                if not ready:
                    break
                chosen = max(ready, key=lambda t: t[2][0])
                rows, at, (_, f, border) = chosen
                tree = [t for t in tree if t is not chosen]
                for part in (rows[x[rows, f] <= border], rows[x[rows, f] > border]):
                    tree.append((part, at + 1, split_of(part, g, h) if at + 1 < depth else (0.0, None, None)))
            sizes.append(len(tree))
            for rows, _, _ in tree:
                scores[rows, k] += rate * (classes - 1) / classes * g[rows].sum() / max(h[rows].sum(), 1e-6)
    return np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True), sizes


def leaves_of(model):
    return [sum(node[0] < 0 for node in tree) for tree in model["trees"]]


@pytest.mark.parametrize("params", [{"rounds": 4, "depth": 3, "rate": 0.1}, {"rounds": 2, "depth": 8, "leaves": 10, "rate": 0.3}, {"rounds": 2, "depth": 8, "leaves": 63, "rate": 0.1, "min_leaf": 5}])
def test_equals_a_plain_grower(params):
    x, y = rows_of(200, 4)
    model = boost.train(x, y, 3, params)
    want, sizes = plain_booster(x, y, 3, **params)
    assert leaves_of(model) == sizes and np.allclose(boost.probabilities(model, x), want, atol=1e-9)


def test_published_sizes():
    x, y = rows_of(400, 8, shift=3.0)
    deep = boost.train(x[:300], y[:300], 3, DEEP)
    p = boost.probabilities(deep, x[300:])
    assert len(deep["trees"]) == 600 and max(leaves_of(deep)) <= 32 and np.allclose(p.sum(axis=1), 1)
    best = boost.train(x[:300], y[:300], 3, {**BEST, "rows": 0.8, "columns": 0.5})
    assert max(leaves_of(best)) <= 63
    assert all(len({node[0] for node in tree if node[0] >= 0}) <= 4 for tree in best["trees"])
    for p in (p, boost.probabilities(best, x[300:])):
        assert (p.argmax(axis=1) == y[300:]).mean() > 0.8


def test_sampled_rows_get_scores_too():
    """Half the rows per round, yet the training scores of all rows are those of the finished model."""
    x, y = rows_of(120, 3)
    seen = {}
    walk = boost.walk
    try:
        boost.walk = lambda tree, part: seen.setdefault("n", len(part)) and walk(tree, part) if len(part) else walk(tree, part)
        model = boost.train(x, y, 3, {"rounds": 6, "depth": 3, "rate": 0.2, "rows": 0.5})
    finally:
        boost.walk = walk
    assert seen["n"] == 60 and (boost.probabilities(model, x).argmax(axis=1) == y).mean() > 0.5


@pytest.mark.parametrize("x", [np.zeros((6, 2)), np.arange(12.0).reshape(6, 2), np.array([[np.float32(1e30), 0.0]] * 3 + [[-1e30, 1.0]] * 3)])
def test_awkward_matrices(x):
    model = boost.train(x.astype(np.float32), np.array([0, 0, 0, 1, 1, 1]), 3, {"rounds": 3, "depth": 2, "rate": 0.5})
    p = boost.probabilities(model, x.astype(np.float32))
    assert np.allclose(p.sum(axis=1), 1) and np.isfinite(p).all() and p[:, 2].max() < 0.2


def frame(spark, n=90, width=4, shift=1.2):
    x, y = rows_of(n, width, shift=shift)
    return spark.createDataFrame([(i, f"S{i % 5}", [float(v) for v in r], int(c) + 1) for i, (r, c) in enumerate(zip(x, y))], "vec_id long, subject_id string, features array<double>, label int").repartition(3), x, y


def test_all_subjects_in_one_job_equal_separate_fits(spark, monkeypatch):
    df, x, y = frame(spark)
    params = {"rounds": 3, "depth": 3, "rate": 0.1}
    for piece_rows in (boost.PIECE_ROWS, 20):
        monkeypatch.setattr(boost, "PIECE_ROWS", piece_rows)
        got = {r.vec_id: r.probability for r in boost.fit_leaving_out(df, "subject_id", "vec_id", F.col("features"), F.col("label") - 1, 3, 4, params).collect()}
        assert len(got) == 90
        for s in range(5):
            inside = df.where(F.col("subject_id") != f"S{s}")
            alone = boost.fit(inside, "vec_id", F.col("features"), F.col("label") - 1, 3, 4, params)
            mine = np.arange(90) % 5 == s
            assert np.allclose([got[i] for i in np.flatnonzero(mine)], boost.probabilities(alone, x[mine]))


def jobs_of(spark, work):
    spark.sparkContext.setJobGroup("counted", "counted")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_grow_with_subjects(spark):
    df, _, _ = frame(spark)
    counts = []
    for subjects in (3, 30):
        own = df.withColumn("subject_id", F.concat(F.lit("S"), (F.col("vec_id") % subjects).cast("string")))
        counts.append(jobs_of(spark, lambda own=own: learn.leave_one_subject_out(own, "Gradient Boosting", {"rounds": 1, "depth": 2}).collect()))
    assert counts[0] == counts[1] > 0


def test_bounds_are_parameters(spark, monkeypatch):
    df, _, _ = frame(spark)
    x, y, _ = boost.sample(df, "vec_id", F.col("features"), F.col("label") - 1, 4, most=20)
    again, _, _ = boost.sample(df.repartition(7), "vec_id", F.col("features"), F.col("label") - 1, 4, most=20)
    assert x.shape == (20, 4) and (x == again).all() and len(y) == 20
    monkeypatch.setattr(boost, "MAX_CELLS", 40)
    assert boost.sample(df, "vec_id", F.col("features"), F.col("label") - 1, 4)[0].shape == (10, 4)


def test_folds_and_importances(spark):
    df, _, _ = frame(spark, shift=3.0)
    params = {"rounds": 5, "depth": 3}
    cv = learn.cross_validate(df, "LightGBM", params, 3).collect()
    assert len(cv) == 3 and all(r.accuracy > 0.75 for r in cv)
    model = learn.fit(df, "Gradient Boosting", params)
    values = {r.pos: r.importance for r in model.importances().collect()}
    assert len(values) == 4 and abs(sum(values.values()) - 1) < 1e-9 and values[3] < max(values.values())
