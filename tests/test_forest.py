"""Forests against a plain grower, and many forests in one job against separate fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import boost, forest, learn

FULL = {**forest.DEFAULTS, "depth": 25, "min_split": 5, "min_leaf": 2, "bootstrap": False, "columns": 10**9}


def rows_of(n, width, seed=3, shift=1.2):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 3
    x = rng.normal(size=(n, width))
    x[np.arange(n), y] += shift
    x[:, -1] = np.round(x[:, -1])  # ties
    return x.astype(np.float32), y


def table(spark, x, y):
    rows = [(i, f"S{i % 5}", [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "vec_id long, subject_id string, features array<double>, number int")


def gini(y, w):
    share = np.array([w[y == k].sum() for k in range(3)]) / w.sum()
    return w.sum() * (1 - (share**2).sum())


def plain_tree(x, y, w, depth, min_split, min_leaf, edges):
    """Every split is searched in the rows themselves. Returns the chances of each row's leaf."""
    out = np.zeros((len(y), 3))

    def divide(rows, level):
        out[rows] = [w[rows][y[rows] == k].sum() / w[rows].sum() for k in range(3)]
        if level >= depth or len(rows) < min_split or len(set(y[rows])) < 2:
            return
        best = (0.0, None, None)
        for f in range(x.shape[1]):
            for border in edges[f]:
                left, right = rows[x[rows, f] <= border], rows[x[rows, f] > border]
                if min(len(left), len(right)) >= min_leaf:
                    drop = gini(y[rows], w[rows]) - gini(y[left], w[left]) - gini(y[right], w[right])
                    if round(drop, 10) > round(best[0], 10):
                        best = (drop, f, border)
        if best[0] > 1e-9:
            divide(rows[x[rows, best[1]] <= best[2]], level + 1)
            divide(rows[x[rows, best[1]] > best[2]], level + 1)

    divide(np.arange(len(y)), 0)
    return out


@pytest.mark.parametrize("balanced", [False, True])
def test_a_tree_equals_the_plain_grower(balanced):
    x, y = rows_of(150, 4)
    keep = (y != 2) | (np.arange(150) < 60)
    x, y = x[keep], y[keep]
    edges = boost.bin_edges(x)
    tree = forest.grow(boost.binned(x, edges), edges, y, 3, {**FULL, "balanced": balanced}, 0)
    want = plain_tree(x, y, forest.class_weights(y, 3, balanced), 25, 5, 2, edges)
    assert np.allclose(forest.leaf_chances(tree, x, 3), want, atol=1e-6)
    assert tree["gains"].sum() == pytest.approx(1)


def test_nodes_keep_their_least_sizes():
    x, y = rows_of(400, 6, shift=0.3)
    edges = boost.bin_edges(x)
    bins = boost.binned(x, edges)
    for number in range(3):
        tree = forest.grow(bins, edges, y, 3, {**FULL, "min_split": 20, "min_leaf": 7}, number)
        reach = np.zeros(len(tree["feature"]), int)
        at = np.zeros(len(x), int)
        for _ in range(26):
            np.add.at(reach, at[tree["feature"][at] < 0], 1)
            at = np.where(tree["feature"][at] >= 0, tree["left"][at] + (x[np.arange(len(x)), tree["feature"][at]] > tree["border"][at]), at)
        held = np.bincount(at, minlength=len(reach))
        assert held[tree["feature"] < 0].min() >= 7
    inner = np.flatnonzero(tree["feature"] >= 0)[::-1]
    for node in inner:
        held[node] = held[tree["left"][node]] + held[tree["left"][node] + 1]
        assert held[node] >= 20


def test_equal_rows_and_one_class_make_a_leaf():
    x, y = np.ones((30, 3), np.float32), np.arange(30) % 3
    edges = boost.bin_edges(x)
    tree = forest.grow(boost.binned(x, edges), edges, y, 3, FULL, 0)
    assert tree["feature"].tolist() == [-1] and np.allclose(tree["chance"], 1 / 3)
    one = forest.grow(boost.binned(*(lambda a: (a, boost.bin_edges(a)))(rows_of(30, 3)[0])), edges, np.zeros(30, np.int64), 3, FULL, 0)
    assert one["feature"].tolist() == [-1] and one["chance"].tolist() == [1, 0, 0]


def test_left_out_forests_equal_separate_fits(spark, monkeypatch):
    monkeypatch.setattr(forest, "PIECE_ROWS", 20)
    x, y = rows_of(150, 5)
    df = table(spark, x, y)
    p = {"trees": 23, "depth": 25, "min_split": 5, "min_leaf": 2, "balanced": True}
    got = {r.vec_id: r.probability for r in forest.fit_leaving_out(df, "subject_id", "vec_id", F.col("features"), F.col("number"), 3, 5, p).collect()}
    assert len(got) == 150
    for s in range(5):
        trees = forest.fit(df.where(F.col("subject_id") != f"S{s}"), "vec_id", F.col("features"), F.col("number"), 3, 5, p)
        assert len(trees) == 23
        mine = np.arange(150) % 5 == s
        want = np.mean([forest.leaf_chances(t, x[mine], 3) for t in trees], axis=0)
        assert np.allclose([got[i] for i in np.flatnonzero(mine)], want, atol=1e-9)


def test_jobs_do_not_grow_with_the_subjects(spark):
    x, y = rows_of(240, 4, shift=3.0)
    tracker = spark.sparkContext.statusTracker()

    def jobs(subjects):
        df = table(spark, x, y).withColumn("subject_id", F.concat(F.lit("S"), (F.col("vec_id") % subjects).cast("string"))).withColumnRenamed("number", "label")
        spark.sparkContext.setJobGroup(f"loso-{subjects}", "loso")
        out = learn.leave_one_subject_out(df, "Random Forest", {"trees": 10})
        assert out.where("actual = predicted").count() > 216 and out.select("subject_id").distinct().count() == subjects
        return len(tracker.getJobIdsForGroup(f"loso-{subjects}"))

    assert jobs(80) <= jobs(4) + 2
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_the_sample_is_bounded(spark):
    x, y = rows_of(90, 4)
    trees = forest.fit(table(spark, x, y), "vec_id", F.col("features"), F.col("number"), 3, 4, {"trees": 2, "depth": 25, "min_leaf": 10, "most": 30})
    assert all((t["feature"] < 0).sum() <= 3 for t in trees)


def test_trees_grown_side_by_side_are_those_grown_alone():
    """Each tree has its own random numbers and order of nodes, whatever grows beside it."""
    x, y = rows_of(700, 6)[:2]
    edges = boost.bin_edges(x)
    bins, p = boost.binned(x, edges), {**forest.DEFAULTS, "depth": 25, "min_split": 5, "min_leaf": 2, "balanced": True}
    for tree, number in zip(forest.grow_all(bins, edges, y, 3, p, [3, 4, 9]), [3, 4, 9]):
        alone = forest.grow(bins, edges, y, 3, p, number)
        assert len(tree["feature"]) > 50 and all(np.array_equal(tree[c], alone[c]) for c in alone)


@pytest.mark.parametrize("classes", [1, 3])
def test_packed_trees_are_the_same_and_small(classes):
    x, y = rows_of(3000, 8, shift=0.1)[:2]
    edges = boost.bin_edges(x)
    tree = forest.grow(boost.binned(x, edges), edges, y % classes, classes, {**forest.DEFAULTS, "depth": 25, "min_split": 5, "min_leaf": 2}, 1)
    packed = forest.pack(tree)
    again = forest.unpack(packed)
    assert list(again) == list(tree) and all(np.array_equal(tree[c], again[c]) and tree[c].dtype == again[c].dtype for c in tree)
    if classes > 1:
        assert 3 * len(packed) < sum(tree[c].nbytes for c in tree)


def test_one_forest_reaches_the_driver_packed(spark, monkeypatch):
    x, y = rows_of(60, 4)[:2]
    seen, grown = [], forest._grown
    monkeypatch.setattr(forest, "_grown", lambda *a, **kw: seen.append(grown(*a, **kw)) or seen[-1])
    assert len(forest.fit(table(spark, x, y), "vec_id", F.col("features"), F.col("number"), 3, 4, {"trees": 12, "depth": 5})) == 12
    assert [f.name for f in seen[0].schema.fields] == ["fold", "block", "tree", "packed"]
