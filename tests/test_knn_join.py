"""The exact join against all pairs, with small blocks, ties and hot distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import knn_join

RNG = np.random.default_rng(21)


def table(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v], i % 3 + 1) for i, v in enumerate(x)], "vec_id long, features array<double>, label int")


def brute(x, q, k):
    d = np.sqrt(((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    return {i: sorted((round(float(v), 9), t) for t, v in enumerate(row))[:k] for i, row in enumerate(d)}


def found(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((round(r.distance, 9), r.tid))
        assert r["rank"] == len(out[r.qid]) and r.label == r.tid % 3 + 1
    return out


@pytest.mark.parametrize("block", [50, 13, 10_000])
def test_equals_all_pairs(spark, block):
    ring = RNG.normal(size=(60, 3))
    ring = ring / np.linalg.norm(ring, axis=1, keepdims=True) * 5
    x = np.concatenate([RNG.normal(size=(90, 3)), RNG.normal(size=(40, 3)) * 0.01 + 6, np.tile([[1.0, 1.0, 1.0]], (70, 1)), np.round(RNG.normal(size=(30, 3)) * 2), ring, -ring])
    q = np.concatenate([x[::7], RNG.normal(size=(40, 3)) * 4])
    got = found(knn_join.neighbours(table(spark, x), table(spark, q), 5, block_rows=block))
    assert got == brute(x, q, 5)


def test_few_rows_and_empty_sides(spark):
    x = RNG.normal(size=(3, 2))
    assert found(knn_join.neighbours(table(spark, x), table(spark, x), 5)) == brute(x, x, 3)
    assert found(knn_join.neighbours(table(spark, x), table(spark, x), 5, block_rows=1)) == brute(x, x, 3)
    some = table(spark, x)
    assert knn_join.neighbours(some.where("vec_id < 0"), some).count() == 0 and knn_join.neighbours(some, some.where("vec_id < 0")).count() == 0


def test_plan_has_no_cross_join_and_prunes(spark, monkeypatch):
    x = np.concatenate([RNG.normal(size=(300, 2)) * 0.1 + c for c in ([0, 0], [50, 0], [120, 0], [300, 0])])
    df = knn_join.neighbours(table(spark, x), table(spark, x[::5]), 3, block_rows=40)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert found(df) == brute(x, x[::5], 3)


def test_a_query_names_its_blocks_by_two_numbers(spark, monkeypatch):
    """Lists of blocks, made in Python for a batch of queries, grow with the table; the neighbours are those of brute force over many blocks."""
    kinds, plain = [], F.pandas_udf
    monkeypatch.setattr(knn_join.F, "pandas_udf", lambda kind: kinds.append(kind) or plain(kind))
    x = np.random.default_rng(3).normal(size=(90, 3)).round(2)
    x[50:60] = 0.5  # a block of equal rows, and empty ones
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, features array<double>")
    got = knn_join.neighbours(df, df, 3, block_rows=4).orderBy("qid", "rank").collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = [t for row in d for t in np.argsort(row, kind="stable")[:3]]
    assert [r.tid for r in got] == want
    assert kinds and not any("array" in str(k) for k in kinds)
