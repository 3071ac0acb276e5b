"""The kernel machines against a dense solver of the same dual problem, the optimum's conditions, and many models in shared jobs against separate fits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import boost, learn, svm


def data(n=240, width=4, classes=3, shift=1.1, seed=5):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % classes
    x = rng.normal(size=(n, width))
    x[np.arange(n), y] += shift
    x[: n // 8] = x[n // 8 : 2 * (n // 8)]  # repeated rows, partly with another class
    return x.astype(np.float32), y


def table(spark, x, y):
    rows = [(i, f"S{i * 7 % 5}", [float(a) for a in v], int(c)) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "vec_id long, subject_id string, features array<double>, label int")


def dense_dual(k, sign, cap, steps=20_000):
    """Projected gradient with momentum on the whole dual; the projection onto box and plane by bisection."""
    q = k * np.outer(sign, sign)
    rate = 1 / np.linalg.eigvalsh(q)[-1]
    a = b = np.zeros(len(sign))

    def project(v):
        lo, hi = -1e4, 1e4
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (sign * np.clip(v - mid * sign, 0, cap)).sum() > 0 else (lo, mid)
        return np.clip(v - (lo + hi) / 2 * sign, 0, cap)

    t = 1.0
    for _ in range(steps):
        new = project(b + rate * (1 - q @ b))
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        b, a, t = new + (t - 1) / t_new * (new - a), new, t_new
    return a.sum() - 0.5 * a @ q @ a


def broken(k, sign, cap, alpha, bias):
    """The worst violation of the optimum's conditions."""
    margin = sign * (k @ (alpha * sign) + bias)
    worst = np.where(alpha <= 0, 1 - margin, np.where(alpha >= cap, margin - 1, np.abs(margin - 1)))
    return max(0.0, worst.max())


@pytest.mark.parametrize("cache", [svm.CACHE_BYTES, 1])
def test_solver_reaches_the_dense_optimum(cache, monkeypatch):
    monkeypatch.setattr(svm, "CACHE_BYTES", cache)
    x, y = data(90, classes=2)
    x, sign = x.astype(np.float64), np.where(y == 0, 1, -1)
    cap = np.where(sign > 0, 2.0, 3.0)
    k = svm.kernel(x, x, 0.3)
    alpha, bias, objective = svm.solve(x, sign, cap, 0.3)
    assert abs((alpha * sign).sum()) < 1e-9 and (alpha >= 0).all() and (alpha <= cap).all()
    assert broken(k, sign, cap, alpha, bias) < 2e-3
    assert objective == pytest.approx(dense_dual(k, sign, cap), rel=1e-3)
    again = svm.solve(x, sign, cap, 0.3, alpha)
    assert np.array_equal(again[0], alpha) and again[2] == pytest.approx(objective)


def test_solver_on_empty_and_one_sided_rows():
    assert svm.solve(np.zeros((0, 2)), np.zeros(0), np.zeros(0), 1.0)[1:] == (0.0, 0.0)
    for side in (1, -1):
        alpha, bias, _ = svm.solve(np.eye(3), np.full(3, side), np.ones(3), 1.0)
        assert not alpha.any() and bias == side


@pytest.mark.parametrize("pieces", [1, 7])
def test_cascade_finds_the_optimum_of_all_rows(spark, pieces):
    x, y = data()
    folds = np.array([None] * len(y), dtype=object)
    sent = spark.sparkContext.broadcast((x, y, folds, 3, 10.0, True))
    s = svm.Sample(*sent.value)
    _, _, _, gamma, caps = s.view(None)
    got = svm.machines(spark, sent, [None], inner=1, pieces=pieces).collect()
    assert len(got) == 6 and all(r.broken == 0 for r in got)
    for r in got:
        ids = s.trained_on(None, r.inner, r.a, r.b)
        z, sign = s.rows(None, ids), np.where(y[ids] == r.a, 1, -1)
        alpha = np.zeros(len(ids))
        alpha[np.searchsorted(ids, r.ids)] = r.alphas
        assert broken(svm.kernel(z, z, gamma), sign, caps[y[ids]], alpha, r.bias) < 4e-3
        assert r.objective == pytest.approx(svm.solve(z, sign, caps[y[ids]], gamma)[2], rel=1e-3)


def test_sigmoid_is_at_its_minimum():
    rng = np.random.default_rng(1)
    value = rng.normal(size=400)
    positive = rng.random(400) < 1 / (1 + np.exp(-2 * value + 0.5))
    slope, offset = svm.sigmoid(value, positive)
    aim = np.where(positive, (positive.sum() + 1) / (positive.sum() + 2), 1 / ((~positive).sum() + 2))
    p = 1 / (1 + np.exp(slope * value + offset))
    assert slope < -1 and abs(((aim - p) * value).sum()) < 1e-3 and abs((aim - p).sum()) < 1e-3


def test_coupling():
    """Consistent pairs give back the probabilities; others the least squares over the simplex."""
    p = np.array([[0.2, 0.5, 0.3], [0.01, 0.01, 0.98]])
    pairs = p[:, :, None] / (p[:, :, None] + p[:, None, :])
    assert np.allclose(svm.couple(pairs), p)
    r = np.full((1, 3, 3), 0.5)
    r[0, 0, 1], r[0, 0, 2], r[0, 1, 2] = 0.9, 0.3, 0.6
    r[0, 1, 0], r[0, 2, 0], r[0, 2, 1] = 0.1, 0.7, 0.4

    def loss(q):
        return sum((r[0, j, i] * q[i] - r[0, i, j] * q[j]) ** 2 for i in range(3) for j in range(3) if i != j)

    best = svm.couple(r)[0]
    grid = [(a / 200, b / 200, 1 - (a + b) / 200) for a in range(201) for b in range(201 - a)]
    assert best.sum() == pytest.approx(1) and loss(best) <= min(map(loss, grid)) + 1e-9
    assert np.allclose(svm.couple(np.full((2, 1, 1), 0.5)), 1)


def test_leaving_subjects_out_equals_separate_fits(spark):
    x, y = data(150)
    df = table(spark, x, y)
    own = svm.fit_leaving_out(df, "subject_id", "vec_id", F.col("features"), F.col("label"), 3, 4, {"C": 10.0, "balanced": True, "pieces": 2})
    got = {r.vec_id: (r.probability, r.votes) for r in own.collect()}
    assert len(got) == 150
    for left in ("S0", "S3"):
        model = svm.fit(df.where(F.col("subject_id") != left), "vec_id", F.col("features"), F.col("label"), 3, 4, {"C": 10.0, "balanced": True, "pieces": 2})
        told = df.where(F.col("subject_id") == left).select("vec_id", svm.scorer(spark, model)(F.col("features")).alias("v")).collect()
        assert np.mean([got[r.vec_id][1] == r.v.votes for r in told]) > 0.95
        assert max(abs(a - b) for r in told for a, b in zip(got[r.vec_id][0], r.v.probability)) < 0.05


def test_probabilities_are_calibrated_and_jobs_do_not_grow_with_subjects(spark):
    x, y = data(600, shift=0.9, seed=9)
    df = table(spark, x, y)
    model = learn.fit(df.where("vec_id < 450"), "SVM")
    out = model.score(df.where("vec_id >= 450"), "vec_id").collect()
    p = np.array([r.probability for r in out])
    truth = np.array([r.label for r in out])
    loss = -np.log(p[np.arange(len(p)), truth]).mean()
    assert np.allclose(p.sum(axis=1), 1) and loss < math.log(3) * 0.9
    assert set(model.extra["svm"]) == {"classes", "gamma", "mean", "scale", "machines", "y", "vectors"}

    def jobs(subjects):
        tag = f"svm-{subjects}"
        spark.sparkContext.setJobGroup(tag, tag)
        rows = df.where("vec_id < 120").withColumn("subject_id", (F.col("vec_id") % subjects).cast("string"))
        learn.leave_one_subject_out(rows, "SVM").count()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))

    assert jobs(24) <= jobs(4) + 2


def test_sample_is_bounded_and_a_lone_class_scores_one(spark):
    x, y = data(60)
    df = table(spark, x, y)
    kept, _, _ = boost.sample(df, "vec_id", F.col("features"), F.col("label"), 4, most=30)
    assert len(kept) == 30
    lone = svm.fit(df.where("label = 1"), "vec_id", F.col("features"), F.lit(0), 1, 4, {"C": 1.0})
    assert {tuple(r.v.probability) for r in df.select(svm.scorer(spark, lone)(F.col("features")).alias("v")).collect()} == {(1.0,)}


def test_large_machines_are_solved_in_blocks(monkeypatch):
    """A kernel beyond the cache is computed in few matrix products, and the optimum is the one of single rows."""
    x, y = data(600, classes=2, shift=0.4)
    x, sign, cap = x.astype(np.float64), np.where(y == 0, 1, -1), np.full(600, 10.0)
    want = svm.solve(x, sign, cap, 0.3)
    calls, kernel = [], svm.kernel
    monkeypatch.setattr(svm, "kernel", lambda *a: calls.append(1) or kernel(*a))
    monkeypatch.setattr(svm, "CACHE_BYTES", 1 << 16)
    monkeypatch.setattr(svm, "WORKING", 60)
    for start in (None, np.where(want[0] > 0, want[0] / 2, 0.0)):
        alpha, bias, objective = svm.solve(x, sign, cap, 0.3, start)
        assert abs(objective - want[2]) < 1e-3 * want[2] and abs(bias - want[1]) < 0.01
        assert broken(kernel(x, x, 0.3), sign, cap, alpha, bias) < 2 * svm.GAP
        assert len(calls) < 600
        calls.clear()


def test_a_piece_holds_the_whole_sample():
    """Pieces of a machine of support vectors would each solve nearly all of it."""
    assert svm.PIECE >= svm.MAX_ROWS
