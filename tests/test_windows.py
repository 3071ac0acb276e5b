import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import features, hrv, ordering, spectral, stats, windows
from sensorloom.operators.windows import WindowSpec
from sensorloom.schema import CHANNELS, feature_names

RNG = np.random.default_rng(7)


@pytest.mark.parametrize("args,size,step", [
    ((5, 700, 0.9), 3500, 349), ((5, 700, 0.5), 3500, 1750), ((1, 700, 0.0), 700, 700), ((1, 10, 5.0), 10, 1), ((1, 10, -1), 10, 10),
])
def test_geometry(args, size, step):
    spec = WindowSpec.of(*args)
    assert (spec.size, spec.step) == (size, step)


def brute_windows(x, size, step):
    n = (len(x) - size) // step + 1 if len(x) >= size else 0
    return [x[i * step : i * step + size] for i in range(n)]


@pytest.mark.parametrize("size,step,n", [(8, 4, 50), (8, 8, 17), (10, 3, 41), (7, 2, 6), (7, 5, 7), (5, 1, 9)])
def test_complete_windows_only(series, size, step, n):
    x = RNG.normal(size=n)
    df = windows.aggregate(series({"a": {"x": x, "label": 1}}), WindowSpec(size, step), [F.sum("x").alias("s")])
    got = {r.window_id: r.s for r in df.collect()}
    want = brute_windows(x, size, step)
    assert sorted(got) == list(range(len(want)))
    assert np.allclose([got[i] for i in range(len(want))], [w.sum() for w in want])


def test_count_formula(spark):
    spec = WindowSpec(8, 4)
    n = [r.w for r in spark.createDataFrame([(i,) for i in (0, 5, 7, 8, 11, 12)], "n long").select(spec.count(F.col("n")).alias("w")).collect()]
    assert n == [0, 0, 0, 1, 1, 2]


def test_majority_tie_is_smallest_and_panes_agree(series):
    label = RNG.integers(1, 4, size=403)
    df = series({"a": {"x": RNG.normal(size=403), "label": label}, "b": {"x": RNG.normal(size=5), "label": [2] * 5}})
    spec = WindowSpec(12, 6)
    want = {i: int(np.bincount(w).argmax()) for i, w in enumerate(brute_windows(label, 12, 6))}
    general = {r.window_id: r.label for r in windows.label_windows(df, spec).collect()}
    panes = {r.window_id: r.label for r in windows.pane_label_windows(df, spec, [1, 2, 3], means=["x"]).collect()}
    assert general == want and panes == want
    with pytest.raises(ValueError):
        windows.pane_label_windows(df, WindowSpec(10, 3), [1, 2, 3])


def test_filter_before_numbering(spark):
    rows = [("a", i, [0, 1, 7, 2, 3][i % 5]) for i in range(20)]
    df = windows.reindex(spark.createDataFrame(rows, "subject_id string, idx long, label int"), ["idx"])
    got = [(r.pos, r.idx) for r in df.orderBy("pos").collect()]
    assert got == list(enumerate(i for i in range(20) if i % 5 in (1, 3, 4)))


def test_blocked_plans_equal_plain_ones(spark):
    """A key with most of the rows, cut into many blocks; ties and a missing time included."""
    n = 3000
    hot = RNG.random(n) < 0.7
    rows = [("hot" if h else f"k{i % 5}", None if i == 11 else int(t), i, float(v)) for i, (h, t, v) in
            enumerate(zip(hot, RNG.integers(0, 500, n), RNG.integers(0, 9, n)))]
    df = spark.createDataFrame(rows, "k string, t long, id long, v double").repartition(6)
    cut, blocked = ordering.order_blocks(df, F.col("t"), target_bytes=2000)
    assert blocked and cut.select(ordering.BLOCK).distinct().count() > 5

    def rows_of(frame, col):
        return sorted((r.id, r[col]) for r in frame.collect())

    order = [F.col("t"), F.col("id")]
    assert rows_of(ordering.dense_position(cut, ["k"], order, blocked=True), "pos") == rows_of(ordering.dense_position(df, ["k"], order), "pos")
    a = ordering.previous_value(cut, ["k"], ["t", "id"], {"v": "p"}, blocked=True)
    b = ordering.previous_value(df, ["k"], ["t", "id"], {"v": "p"})
    assert sorted(rows_of(a, "p"), key=str) == sorted(rows_of(b, "p"), key=str)
    a = ordering.running_before(cut, ["k"], order, "v", "s", blocked=True)
    assert rows_of(a, "s") == rows_of(ordering.running_before(df, ["k"], order, "v", "s"), "s")


def brute_stats(w):
    m, s = w.mean(), w.std()
    safe = s if s else 1.0
    q = np.quantile(w, [0.25, 0.5, 0.75])
    c = w - m
    return [m, s, w.min(), w.max(), q[1], q[2] - q[0], (c**3).mean() / safe**3, (c**4).mean() / safe**4 - 3]


def brute_spectrum(w, fs):
    mag = np.abs(np.fft.rfft(w))
    psd = mag**2
    p = psd / psd.sum() if psd.sum() else psd
    return [(mag[1:].argmax() + 1) * fs / len(w), psd.sum(), -sum(v * np.log2(v) for v in p if v > 0)]


def brute_peaks(x, threshold, distance):
    found, i = [], 1
    while i < len(x) - 1:
        if x[i - 1] < x[i]:
            j = i
            while j + 1 < len(x) and x[j + 1] == x[i]:
                j += 1
            if j + 1 < len(x) and x[j + 1] < x[i]:
                if x[i] >= threshold:
                    found.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    kept = []
    for p in sorted(found, key=lambda p: (x[p], p), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    return sorted(kept)


def brute_hrv(x, fs, distance):
    peaks = brute_peaks(x, np.percentile(x, 70), distance)
    rr = np.diff(peaks) / fs * 1000.0 if len(peaks) > 1 else np.array([])
    rr = rr[(rr > 300) & (rr < 1500)]
    if len(rr) < 2:
        return [0.0] * 5
    d = np.diff(rr)
    return [np.sqrt((d**2).mean()), rr.std(ddof=1), rr.mean(), (abs(d) > 50).mean() * 100, 60000 / rr.mean()]


def test_feature_vector_against_numpy(series):
    """All 159 features of 14 channels, with plateaus in the ECG and a constant channel."""
    n, fs = 900, 20
    cols = {c: RNG.normal(size=n) * (i + 1) for i, c in enumerate(CHANNELS)}
    cols["Chest ECG"] = np.round(np.sin(np.arange(n) / 2.5) * 3 + RNG.normal(size=n) * 0.4, 1)
    cols["Wrist Temp"] = np.full(n, 33.3)
    spec = WindowSpec(200, 100)
    df = features.window_features(series({"s": {**cols, "label": RNG.integers(1, 4, n)}}), spec, CHANNELS, fs, ecg="Chest ECG")
    got = {r.window_id: np.array(r.features) for r in df.collect()}
    names = feature_names()
    assert sorted(got) == list(range(8))
    for i, v in got.items():
        assert len(v) == 159
        w = {c: cols[c][i * 100 : i * 100 + 200] for c in CHANNELS}
        by_channel = {c: brute_stats(w[c]) + brute_spectrum(w[c], fs) for c in CHANNELS}
        by_channel["Wrist Temp"][1:2] = [0.0]
        by_channel["Wrist Temp"][6:8] = [0.0, -3.0]
        want = [by_channel[c][s] for s in range(11) for c in CHANNELS] + brute_hrv(w["Chest ECG"], fs, int(0.3 * fs))
        for name, a, b in zip(names, v, want):
            if not name.startswith("Wrist Temp_dom"):
                assert a == pytest.approx(b, rel=1e-6, abs=1e-6), (i, name)


def test_constant_window(series):
    df = series({"s": {"x": np.ones(50), "label": [1] * 50}})
    batch = stats.time_stats(df, WindowSpec(50, 50), ["x"]).first()
    single = stats.time_stats(df, WindowSpec(50, 50), ["x"], constant_kurtosis=stats.CONSTANT_KURTOSIS_SINGLE).first()
    assert (batch.x_mean, batch.x_std, batch.x_skew, batch.x_kurtosis, single.x_kurtosis) == (1.0, 0.0, 0.0, -3.0, 0.0)


def test_sine_frequency_and_entropy_bounds(series):
    fs, n = 64, 256
    t = np.arange(n) / fs
    df = series({"s": {"x": np.sin(2 * np.pi * 8 * t), "z": np.zeros(n), "label": [1] * n}})
    arrays = stats.window_arrays(df, WindowSpec(n, n), ["x", "z"])
    r = spectral.spectral_stats(arrays, ["x", "z"], fs, n).first()
    assert r.x_dom_freq == 8.0 and 0 <= r.x_spectral_entropy < 1e-6
    assert r.z_spectral_energy == 0 and r.z_spectral_entropy == 0
    assert arrays.select(spectral.energy(F.col("x"), n)).first()[0] == pytest.approx(r.x_spectral_energy)


@pytest.mark.parametrize("n", [9, 10])
def test_parseval_energy(series, n):
    x = RNG.normal(size=n)
    arrays = stats.window_arrays(series({"s": {"x": x, "label": [1] * n}}), WindowSpec(n, n), ["x"])
    want = (np.abs(np.fft.rfft(x)) ** 2).sum()
    assert arrays.select(spectral.energy(F.col("x"), n)).first()[0] == pytest.approx(want)
    agg = windows.aggregate(series({"s": {"x": x, "label": [1] * n}}), WindowSpec(n, n),
                            [spectral.energy_aggregate(F.col("x"), F.col("pos"), n).alias("e")])
    assert agg.first().e == pytest.approx(want)
    psd = F.transform(spectral.magnitudes("x"), lambda m: m * m)
    p = np.abs(np.fft.rfft(x)) ** 2
    p = p / p.sum()
    assert arrays.withColumn("p", psd).select(spectral.entropy(F.col("p"))).first()[0] == pytest.approx(-(p * np.log2(p)).sum())


@pytest.mark.parametrize("x,peaks", [
    ([0, 1, 0, 2, 2, 0, 3], [1, 3]), ([5, 1, 1, 5], []), ([0, 2, 2, 2, 0], [2]), ([1, 1, 1], []), ([0, 1, 2, 1, 0], [2]), ([1.0], []),
])
def test_plateaus_and_edges(spark, x, peaks):
    df = spark.createDataFrame([([float(v) for v in x],)], "x array<double>")
    got = hrv.with_local_maxima(df, "x", F.lit(-1e9)).first().peaks
    assert [p.p for p in got] == peaks


@pytest.mark.parametrize("distance", [1, 2, 3, 7])
def test_suppression_against_greedy(spark, distance):
    rows = [([float(v) for v in RNG.integers(0, 6, 60)],) for _ in range(30)]
    df = hrv.with_local_maxima(spark.createDataFrame(rows, "x array<double>"), "x", F.lit(0.0))
    for r in df.withColumn("kept", hrv.suppress(F.col("peaks"), distance)).collect():
        assert r.kept == brute_peaks(np.array(r.x), 0.0, distance)


def test_impulse_train(series):
    fs, n = 700, 7000
    x = np.zeros(n)
    x[100::560] = 1.0
    arrays = stats.window_arrays(series({"s": {"x": x, "label": [1] * n}}), WindowSpec(n, n), ["x"])
    r = hrv.hrv_features(arrays, "x", F.lit(0.5), fs).first()
    assert (r.hrv_rmssd, r.hrv_sdnn, r.hrv_mean_rr, r.hrv_pnn50, r.hrv_hr) == (0.0, 0.0, 800.0, 0.0, 75.0)
