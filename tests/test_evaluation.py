import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.functions import labels as L
from sensorloom.operators import align, graph, history, importance, metrics, results, scaling, sensors, splits

RNG = np.random.default_rng(5)


def brute_auc(score, hit):
    p, n = score[hit], score[~hit]
    return np.mean([(a > b) + 0.5 * (a == b) for a in p for b in n])


@pytest.mark.parametrize("target_bytes", [None, 500])
def test_auc_with_ties_and_blocks(spark, target_bytes):
    score, hit = RNG.integers(0, 40, 400) / 40.0, RNG.random(400) < 0.3
    df = spark.createDataFrame([(float(s), bool(h)) for s, h in zip(score, hit)], "s double, h boolean")
    r = metrics.auc(df, "s", F.col("h"), target_bytes=target_bytes).first()
    assert r.auc == pytest.approx(brute_auc(score, hit)) and (r.n_pos, r.n_neg) == (hit.sum(), (~hit).sum())


def test_auc_by_class_and_missing_class(spark):
    y = RNG.integers(1, 4, 200)
    p = RNG.random((200, 3))
    df = spark.createDataFrame([(int(a), *map(float, q)) for a, q in zip(y, p)], "actual int, p1 double, p2 double, p3 double")
    want = sum(brute_auc(p[:, c - 1], y == c) * (y == c).sum() for c in (1, 2, 3)) / 200
    cols = {c: f"p{c}" for c in (1, 2, 3)}
    assert metrics.roc_auc(df, cols).first().roc_auc == pytest.approx(want)
    assert metrics.roc_auc(df.where("actual <> 3"), cols).first().roc_auc is None
    two = df.where("actual <> 3")
    keep = y != 3
    assert metrics.roc_auc(two, {1: "p1", 2: "p2"}).first().roc_auc == pytest.approx(brute_auc(p[keep, 1], y[keep] == 2))
    assert metrics.roc_auc(df.where("actual = 2"), {1: "p1", 2: "p2"}).first().roc_auc is None


def test_scores_by_hand(spark):
    pairs = [(1, 1)] * 5 + [(1, 2)] * 2 + [(2, 2)] * 3 + [(3, 1)] * 2 + [(2, 9)]
    df = spark.createDataFrame(pairs, "actual int, predicted int")
    per = {r.label: r for r in metrics.class_scores(metrics.confusion(df)).collect()}
    assert per[1].precision == pytest.approx(5 / 7) and per[1].recall == pytest.approx(5 / 7)
    assert per[3].f1 == 0.0 and per[9].precision == 0.0 and per[9].support == 0
    total = metrics.overall_scores(metrics.class_scores(metrics.confusion(df))).first()
    f1 = {1: 5 / 7, 2: 6 / 9, 3: 0.0, 9: 0.0}
    assert total.accuracy == pytest.approx(8 / 13) and total.f1_macro == pytest.approx(sum(f1.values()) / 4)
    assert total.f1_weighted == pytest.approx((7 * f1[1] + 4 * f1[2]) / 13)
    grid = metrics.confusion_grid(metrics.confusion(df)).collect()
    assert len(grid) == 16 and sum(r.n for r in grid) == 13
    assert metrics.confusion_grid(metrics.confusion(df), labels=[1, 2]).count() == 4


def test_ranking_is_stable_and_keeps_failures(spark):
    rows = [("s", 0, "a", 0.8), ("s", 1, "b", 0.9), ("s", 2, "c", 0.9), ("s", 3, "d", 0.95)]
    df = spark.createDataFrame(rows, "subject_id string, catalogue_idx int, name string, accuracy double")
    df = metrics.with_failures(df, F.when(F.col("name") == "d", "boom"), ["accuracy"])
    ranked = [(r.name, r.is_best) for r in metrics.rank_models(df, ["subject_id"]).orderBy("rank").collect()]
    assert ranked == [("b", True), ("c", False), ("a", False), ("d", False)]
    assert metrics.best_model(df, ["subject_id"], "name").first().name == "b"


def test_loso_needs_three_subjects(spark):
    df = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("b", 2, 2)], "subject_id string, actual int, predicted int")
    per = metrics.loso_scores(df)
    assert {r.subject_id: r.accuracy for r in per.collect()} == {"a": 1.0, "b": 0.5}
    assert metrics.loso_summary(per).count() == 0
    more = df.unionByName(spark.createDataFrame([("c", 1, 2)], df.schema))
    r = metrics.loso_summary(metrics.loso_scores(more)).first()
    assert r.loso_mean_accuracy == pytest.approx(0.5) and r.loso_std_accuracy == pytest.approx(np.std([1, 0.5, 0]))


@pytest.mark.parametrize("target_bytes", [None, 400])
def test_splits_are_exact_and_repeatable(spark, target_bytes):
    df = spark.createDataFrame([(i, 1 if i % 3 else i % 2 + 2) for i in range(1003)], "id long, label int")
    one = splits.stratified(df, "label", ["id"], target_bytes=target_bytes)
    again = splits.stratified(df.repartition(7), "label", ["id"])
    assert {r.id for r in one.where("is_test").collect()} == {r.id for r in again.where("is_test").collect()}
    for r in one.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect():
        assert r.t == int(r.n * 0.2 + 0.5)
    folds = splits.kfold(df, "label", ["id"], target_bytes=target_bytes).groupBy("label").pivot("fold").count().collect()
    assert all(max(r[1:]) - min(r[1:]) <= 1 for r in folds)
    mask = splits.random_mask(df, ["id"], target_bytes=target_bytes)
    assert mask.where("is_train").count() == 802 and mask.count() == 1003


def test_standardise_gate_and_weights(spark):
    x = RNG.normal(size=(50, 3)) * [1, 5, 0] + [0, 2, 7]
    df = spark.createDataFrame([(i, [float(v) for v in r], i % 2 + 1) for i, r in enumerate(x)], "id int, features array<double>, label int")
    got = np.array([r.features for r in scaling.standardize(df).orderBy("id").collect()])
    want = np.column_stack([(x[:, j] - x[:, j].mean()) / x[:, j].std() for j in (0, 1)] + [np.zeros(50)])
    assert np.allclose(got, want)
    g = x.mean(axis=0) * 0.5 + x.std(axis=0, ddof=1) * 2
    gate = 1 / (1 + np.exp(-(g - g.mean()) / np.sqrt(g.var() + 1e-5)))
    got = np.array([r.features for r in scaling.recalibrate(df, 0.5, 2.0).orderBy("id").collect()])
    assert np.allclose(got, x * gate)
    w = {r.label: r.weight for r in scaling.class_weights(df.where("id < 30 or label = 1")).collect()}
    assert w[1] == pytest.approx(40 / (2 * 25)) and w[2] == pytest.approx(40 / (2 * 15))


def test_top_importances(spark):
    df = spark.createDataFrame([(i, float(i % 7) / 10) for i in range(40)], "pos int, importance double")
    rows = importance.top(df, 15).collect()
    assert len(rows) == 15 and [r.pos for r in rows[:3]] == [6, 13, 20]


# --- Results and history -----------------------------------------------------------------------


def predictions(spark, rows):
    return spark.createDataFrame(rows, "subject_id string, window_id long, prediction int, conf double")


def test_result_of_many_windows(spark):
    df = predictions(spark, [("a", i, p, 0.9) for i, p in enumerate([1, 2, 2, 3, 7, 1])])
    r = results.summarise(df, "pre-trained", confidence="conf").first()
    assert (r.total_windows, r.stress_ratio, r.overall_stress, r.stress_level, r.is_manual) == (5, 0.5, True, "High Stress", False)
    assert r.label_counts == {"Baseline": 2, "Stress": 2, "Amusement": 1} and r.predicted_label == "Baseline"
    assert r.captured_at.endswith("Z") and len(r.captured_at) == 20


@pytest.mark.parametrize("prediction,conf,stressed,level", [(1, 0.1, False, "Low Stress"), (2, 0.85, True, "Critical Stress"), (1, 0.6, False, "Low Stress")])
def test_single_prediction(spark, prediction, conf, stressed, level):
    r = results.summarise(predictions(spark, [("a", 0, prediction, conf)]), "manual input", confidence="conf").first()
    assert (r.is_manual, r.overall_stress, r.stress_level, r.stress_ratio) == (True, stressed, level, conf)
    entry = results.history_entry(results.summarise(predictions(spark, [("a", 0, prediction, conf)]), "m"), F.lit("T1")).first()
    assert entry.tracking_id == "T1" and entry.total_windows == 1


def test_timeline_chunks(spark):
    df = predictions(spark, [("a", i, i % 3 + 1, 0.0) for i in range(10)]).repartition(3)
    rows = results.timeline(df, chunk=4).orderBy("chunk").collect()
    assert [len(r.labels) for r in rows] == [4, 4, 2]
    assert sum((r.labels for r in rows), []) == [i % 3 + 1 for i in range(10)]


def entries(spark, n, key="T", start=0):
    rows = [(key, f"2026-03-{1 + i // 1440:02d} {i // 60 % 24:02d}:{i % 60:02d}:00", i, i / 1000.0) for i in range(start, start + n)]
    df = spark.createDataFrame(rows, "tracking_id string, t string, seq long, stress_ratio double")
    return df.select("tracking_id", F.to_timestamp("t").alias("captured_at"), "seq", "stress_ratio")


def test_cap_keeps_newest_500(spark):
    out = history.append(entries(spark, 500).unionByName(entries(spark, 3, "U")), entries(spark, 7, start=500))
    seqs = sorted(r.seq for r in out.where("tracking_id = 'T'").collect())
    assert seqs == list(range(7, 507)) and out.where("tracking_id = 'U'").count() == 3


def test_cap_plan_trims_before_the_shuffle(spark, sf):
    from sensorloom.plans import bindings as B

    plan = history.newest(B.hist(spark, sf), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_summary_and_trend(spark):
    rows = [("A", 0.15, 1), ("A", 0.55, 2), ("A", 0.35, 3), ("B", 0.5, 1), ("C", 0.30, 1), ("C", 0.32, 2)]
    df = spark.createDataFrame([(k, f"2026-03-1{s}", s, v) for k, v, s in rows], "tracking_id string, t string, seq long, stress_ratio double")
    df = df.select("tracking_id", F.to_timestamp("t").alias("captured_at"), "seq", "stress_ratio")
    got = {r.tracking_id: r for r in history.summary(df).collect()}
    assert (got["A"]["count"], got["A"].latest, got["A"].previous, got["A"].delta, got["A"].trend) == (3, 0.35, 0.55, -0.2, "down")
    assert got["B"].delta is None and got["B"].trend == "stable"
    assert got["C"].delta == 0.02 and got["C"].trend == "stable"


def test_range_is_inclusive_and_pushed_down(spark, sf, capsys):
    df = entries(spark, 10)
    got = history.in_range(df, "T", "2026-03-01 00:02:00", "2026-03-01 00:04:00").collect()
    assert sorted(r.seq for r in got) == [2, 3, 4]
    from sensorloom.plans import bindings as B

    history.in_range(B.hist(spark, sf), start="1996-01-01", end="1997-01-01").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThanOrEqual(o_orderdate" in plan


def test_deltas_in_blocks(spark):
    df = entries(spark, 300).unionByName(entries(spark, 20, "U"))
    a = sorted((r.tracking_id, r.seq, str(r.previous_ratio)) for r in history.deltas(df).collect())
    b = sorted((r.tracking_id, r.seq, str(r.previous_ratio)) for r in history.deltas(df, target_bytes=800).collect())
    assert a == b


def test_encode_decode(spark):
    df = spark.createDataFrame([(True, False, {"Stress": 2}), (None, True, None)], "is_manual boolean, overall_stress boolean, label_counts map<string,bigint>")
    rows = history.decode(history.encode(df)).collect()
    assert [(r.is_manual, r.overall_stress, r.label_counts) for r in rows] == [(True, False, {"Stress": 2}), (False, True, {})]
    blank = spark.createDataFrame([(1, 0, "")], "is_manual int, overall_stress int, label_counts string")
    assert history.decode(blank).first().label_counts == {}


# --- Joins, sensors, graph ---------------------------------------------------------------------


def test_first_available_and_pending(spark):
    def ids(*v):
        return spark.createDataFrame([(x,) for x in v], "subject_id string")

    got = align.first_available([("memory", ids("a")), ("stored", ids("a", "b")), ("computed", ids("a", "b", "c"))], "subject_id")
    assert {r.subject_id: r.source for r in got.collect()} == {"a": "memory", "b": "stored", "c": "computed"}
    assert [r[0] for r in align.to_compute(ids("a", "b", "c"), ids("b", "c"), ids("c"), "subject_id").collect()] == ["b"]


def test_presets_round_trip(spark):
    from sensorloom import schema

    wide = sensors.preset_rows(sensors.presets(schema.sensor_dim(spark)), schema.CHANNELS)
    got = {r.scenario: r for r in wide.collect()}
    assert set(got) == {"low", "high", "critical"} and got["high"]["Chest EDA"] == 6.0 and got["critical"]["Wrist Temp"] == 32.3


def dense_graph(edges, n):
    a = np.zeros((n, n))
    for s, d in edges:
        a[d, s] += 1
    return a


def test_graph_against_matrices(spark):
    n = 9
    chain = [(i, i + 1) for i in list(range(0, 3)) + list(range(5, 7))]
    x = RNG.normal(size=(n, 2))
    nodes = spark.createDataFrame([("g", i, float(x[i, 0]), float(x[i, 1])) for i in range(n)], "k string, pos long, a double, b double")
    edges = graph.both_ways(spark.createDataFrame([("g", s, d) for s, d in chain], "k string, src long, dst long"))
    adj = dense_graph(chain + [(d, s) for s, d in chain], n)
    looped = adj + np.eye(n)
    d = looped.sum(axis=1) ** -0.5
    norm = d[:, None] * looped * d[None, :]
    got = graph.propagate(nodes, edges, ["k"], ["a", "b"], [1.0, 0.5, 0.25, 2.0]).orderBy("pos").collect()
    want = x + 0.5 * norm @ x + 0.25 * norm @ norm @ x + 2 * norm @ norm @ norm @ x
    assert np.allclose([[r.a, r.b] for r in got], want)
    heavy = adj + 2 * np.eye(n)
    h = (adj + np.eye(n)).sum(axis=1) ** -0.5
    got = graph.propagate(nodes, edges, ["k"], ["a"], [0.0, 1.0], improved=True).orderBy("pos").collect()
    assert np.allclose([r.a for r in got], (h[:, None] * heavy * h[None, :]) @ x[:, 0])
    deg = adj.sum(axis=1)
    e = np.where(deg > 0, np.where(deg > 0, deg, 1) ** -0.5, 0)
    lap = -(e[:, None] * adj * e[None, :])
    t = [x[:, 0], lap @ x[:, 0]]
    t += [2 * lap @ t[1] - t[0]]
    t += [2 * lap @ t[2] - t[1]]
    got = graph.chebyshev(nodes, edges, ["k"], ["a"], terms=4)
    for k in range(4):
        assert np.allclose([r.a for r in got.where(F.col("term") == k).orderBy("pos").collect()], t[k])


def test_phases_and_sampling(spark):
    bounds = [("p", 2, 5), ("q", 7, 30)]
    samples = spark.createDataFrame([("g", i) for i in range(10)], "k string, pos long")
    got = {(r.phase, r.src, r.dst) for r in graph.phase_chain(samples, bounds, ["k"]).collect()}
    fwd = [("p", 2, 3), ("p", 3, 4), ("q", 7, 8), ("q", 8, 9)]
    assert got == set(fwd) | {(p, d, s) for p, s, d in fwd}
    star = spark.createDataFrame([("g", i, 0) for i in range(1, 200)], "k string, src long, dst long")
    seeds = spark.createDataFrame([("g", 0)], "k string, pos long")
    drawn = graph.sample_neighbours(seeds, star, ["k"], [10, 10])
    assert drawn.where("hop = 0").count() == 10 and drawn.where("hop = 1").count() == 0
    assert graph.sample_neighbours(seeds, star, ["k"], [-1]).count() == 199


def test_union_of_labels(spark):
    df = spark.createDataFrame([(4, 1), (1, 2), (2, 3)], "actual int, predicted int")
    rows = metrics.eval_rows(df, {1: "Baseline", 2: "Stress"}).collect()
    assert [(r.actual_name, r.predicted_name) for r in rows] == [("Baseline", "Stress"), ("Stress", "Other")]
    assert L.LABEL_NAMES[2] == "Stress"
