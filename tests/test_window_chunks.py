"""Chunks of windows against a plain loop, over chunk borders and incomplete ends."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import stats, window_chunks
from sensorloom.operators.windows import WindowSpec

RNG = np.random.default_rng(8)


def plain(x, label, spec):
    for k in range(0, (len(x) - spec.size) // spec.step + 1):
        w, l = x[k * spec.step :][: spec.size], label[k * spec.step :][: spec.size]
        sd = w.std()
        kinds, counts = np.unique(l, return_counts=True)
        yield k, int(kinds[counts.argmax()]), {
            "mean": w.mean(), "std": sd, "min": w.min(), "max": w.max(), "median": np.median(w), "iqr": np.subtract(*np.percentile(w, [75, 25])),
            "skew": ((w - w.mean()) ** 3).mean() / sd**3 if sd else 0.0, "kurtosis": ((w - w.mean()) ** 4).mean() / sd**4 - 3 if sd else -3.0}


@pytest.mark.parametrize("spec", [WindowSpec(20, 3), WindowSpec(20, 5), WindowSpec(20, 20), WindowSpec(7, 1)])
@pytest.mark.parametrize("rows", [10, 64, 1 << 18])
def test_statistics_equal_a_plain_loop(spark, series, monkeypatch, spec, rows):
    monkeypatch.setattr(window_chunks, "CHUNK_ROWS", rows)
    monkeypatch.setattr(window_chunks, "CELLS", 100)
    data = {"a": 151, "b": 20, "c": 5}
    data = {s: {"x": RNG.normal(size=n).round(1), "y z": np.repeat(2.0, n), "label": RNG.integers(1, 4, n)} for s, n in data.items()}
    got = window_chunks.window_table(series(data), spec, ["x", "y z"], constant_kurtosis=-3.0, label="label", gates={"x": 0.7}, arrays=["x"])
    found = {(r.subject_id, r.window_id): r for r in got.collect()}
    want = {(s, k): (label, figures) for s, d in data.items() for k, label, figures in plain(d["x"], d["label"], spec)}
    assert found.keys() == want.keys()
    for key, (label, figures) in want.items():
        r = found[key]
        assert r.label == label and r["x__gate"] == pytest.approx(np.quantile(r.x, 0.7)) and len(r.x) == spec.size
        for name, value in figures.items():
            assert r[f"x_{name}"] == pytest.approx(value, abs=1e-9)
        assert (r["y z_std"], r["y z_skew"], r["y z_kurtosis"], r["y z_iqr"]) == (0.0, 0.0, -3.0, 0.0)


def test_gaps_nulls_and_empty_tables(spark):
    rows = [("a", p, None if p == 3 else float(p)) for p in [*range(8), *range(9, 30)]]
    df = spark.createDataFrame(rows, "subject_id string, pos long, x double")
    got = {r.window_id: r for r in stats.time_stats(df, WindowSpec(5, 2), ["x"]).collect()}
    assert sorted(got) == [k for k in range(13) if not 2 * k <= 8 < 2 * k + 5]
    assert np.isnan(got[0].x_mean) and np.isnan(got[0].x_max) and got[0].x_min == 0.0 and got[6].x_mean == 14.0
    assert stats.time_stats(df.where("pos < 0"), WindowSpec(5, 2), ["x"]).count() == 0


def test_overlap_does_not_multiply_the_shuffled_rows(spark, monkeypatch):
    """At 90 % overlap a chunk carries its own samples and less than a window more."""
    monkeypatch.setattr(window_chunks, "CHUNK_ROWS", 2000)
    df = spark.range(10_000).select(F.lit("a").alias("subject_id"), F.col("id").alias("pos"), F.col("id").cast("double").alias("x"))
    assert window_chunks.window_table(df, WindowSpec(100, 10), ["x"], constant_kurtosis=-3.0).count() == 991
    plan = window_chunks.window_table(df, WindowSpec(100, 10), ["x"], constant_kurtosis=-3.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    copies = df.select(F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.floor((F.col("pos") - 100) / 10) + 1) / 200), F.floor(F.col("pos") / 2000)))).count()
    assert copies < 1.05 * 10_000
