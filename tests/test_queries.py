"""Every registered query beside its SQL, on the smallest tables."""

import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import normal

ORACLES = oracle_sql()


def compare(spark, sf, duck, name):
    df = queries()[name](spark, sf)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    rel = duck.execute(ORACLES[name])
    want = pd.DataFrame(rel.fetchall(), columns=[d[0] for d in rel.description], dtype=object)
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) > 0
    a, b = normal(got), normal(want)
    assert [tuple(map(str, x)) for x in a] == [tuple(map(str, x)) for x in b]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, duck, name):
    compare(spark, sf, duck, name)


BLOCKED = [
    "flagship", "win_reindex", "agg_time_stats", "win_feature_vector", "agg_roc_auc", "agg_accuracy", "win_history_delta", "split_stratified",
    "split_kfold", "split_random_mask", "st_rate_limit_batch", "join_positional", "align_nan_expand", "resample_linear", "gr_propagate",
]


@pytest.mark.parametrize("name", BLOCKED)
def test_matches_sql_when_no_key_fits_one_task(spark, sf, duck, name, monkeypatch):
    """The plans for large tables, forced by a tiny limit: the same results."""
    monkeypatch.setattr("sensorloom.session.SINGLE_TASK_BYTES", 4000)
    compare(spark, sf, duck, name)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert queries()[name](spark, sf).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(queries())


def test_flagship_counts(spark):
    rows = entry(spark).collect()
    assert sum(r.total_windows for r in rows) == 179
    levels = [r.stress_level for r in rows]
    assert (levels.count("Low Stress"), levels.count("Moderate Stress"), levels.count("High Stress")) == (9, 5, 1)
