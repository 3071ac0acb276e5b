import math

import pytest
from pyspark.sql import functions as F

from sensorloom import schema
from sensorloom.functions import bands, clean, labels, text, vectors


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


@pytest.mark.parametrize("ratio,manual,level", [
    (0.10, False, "Low Stress"), (0.25, False, "Moderate Stress"), (0.50, False, "High Stress"), (0.80, False, "Critical Stress"),
    (0.20, False, "Moderate Stress"), (0.40, False, "High Stress"), (0.65, False, "Critical Stress"),
    (0.20, True, "Low Stress"), (0.40, True, "Moderate Stress"), (0.60, True, "High Stress"), (0.90, True, "Critical Stress"),
    (0.35, True, "Moderate Stress"), (0.50, True, "High Stress"), (0.75, True, "Critical Stress"),
])
def test_bands(spark, ratio, manual, level):
    assert one(spark, bands.stress_band(F.lit(ratio), F.lit(manual))).stress_level == level


def test_single_calm_prediction_is_low(spark):
    band = bands.verdict_band(F.lit(0.9), F.lit(True), F.lit(False))
    assert one(spark, band).stress_level == "Low Stress"
    assert one(spark, bands.overall_stress(F.lit(0.1), F.lit(True), F.lit(True))) is True
    assert one(spark, bands.overall_stress(F.lit(0.30), F.lit(False), F.lit(True))) is False


@pytest.mark.parametrize("value,high,critical,band", [
    (7.0, 6.0, 7.0, "critical"), (6.5, 6.0, 7.0, "stress"), (1.0, 6.0, 7.0, "baseline"),
    (5.0, 0.0, 0.0, "baseline"), (5.0, 4.0, 0.0, "stress"), (-9.0, -9.4, -12.0, "critical"),
])
def test_sensor_band(spark, value, high, critical, band):
    assert one(spark, bands.sensor_band(F.lit(value), F.lit(high), F.lit(critical))) == band


def test_clean(spark):
    nan, inf = float("nan"), float("inf")
    raw = [one(spark, clean.sanitize_raw(F.lit(v).cast("double"))) for v in (nan, None, inf, -inf, 2.5)]
    assert raw == [0.0, 0.0, clean.FLOAT32_MAX, -clean.FLOAT32_MAX, 2.5]
    vec = F.array(*[F.lit(v).cast("double") for v in (nan, inf, -inf, 1.0)])
    assert one(spark, clean.sanitize_features(vec)) == [0.0, 0.0, 0.0, 1.0]
    m = F.create_map(F.lit("a"), F.lit("1.5"), F.lit("b"), F.lit("x"))
    assert [one(spark, clean.sensor_value(m, k)) for k in "abc"] == [1.5, 0.0, 0.0]


def test_labels(spark):
    assert [one(spark, labels.label_name(F.lit(v))) for v in (1, 2, 3, 9)] == ["Baseline", "Stress", "Amusement", "Unknown(9)"]
    assert one(spark, labels.stress_ratio(F.lit(0), F.lit(0))) == 0.0
    assert one(spark, labels.stress_ratio(F.lit(3), F.lit(1))) == 0.75
    assert one(spark, labels.recode(F.lit(7))) == 5


@pytest.mark.parametrize("raw,clean_id", [
    ("  Ana 01 ", "Ana_01"), ("../../etc/passwd", "etc_passwd"), ("a b\tc", "a_b_c"), ("***", ""), (None, ""), ("._x._", "x"),
])
def test_tracking_id(spark, raw, clean_id):
    assert one(spark, text.tracking_id(F.lit(raw).cast("string"))) == clean_id


def test_tracking_id_folds_accents(spark):
    assert one(spark, text.tracking_id(F.lit("Zoë Ångström"))) == "Zoe_Angstrom"


def test_natural_order(spark):
    ids = ["S10", "S2", "S1", "A3", "S02b"]
    df = spark.createDataFrame([(i,) for i in ids], "s string").orderBy(text.natural_key(F.col("s")))
    assert [r.s for r in df.collect()] == ["A3", "S1", "S2", "S02b", "S10"]


def test_history_bounds(spark):
    df = spark.range(1).select(
        text.history_bound(F.lit("2026-03-17T10:30")).alias("a"), text.history_bound(F.lit("2026-03-17T10:30"), True).alias("b"),
        text.history_bound(F.lit("2026-03-17T10:30"), zone="Europe/Berlin").alias("c"), text.history_bound(F.lit("nope")).alias("d"))
    r = df.select(*[F.date_format(c, "HH:mm:ss.SSS").alias(c) for c in "abcd"]).first()
    assert tuple(r) == ("10:30:00.000", "10:30:59.999", "09:30:00.000", None)


def test_feature_names():
    names = schema.feature_names()
    assert len(names) == 159 and len(set(names)) == 159
    assert names[:2] == ["Chest Acc X_mean", "Chest Acc Y_mean"] and names[14] == "Chest Acc X_std" and names[-1] == "ECG_hrv_hr"


def test_manual_vector(spark):
    readings = [float(i) for i in range(14)]
    v = one(spark, vectors.manual_vector([F.lit(x) for x in readings]))
    assert len(v) == 159 and v[:14] == readings and v[-5:] == [30.0, 50.0, 800.0, 20.0, 75.0]
    assert math.isclose(v[14 + 3], 0.08 * (3 + 1e-6)) and math.isclose(v[28 + 3], 2.7) and math.isclose(v[42 + 3], 3.3)
    assert one(spark, vectors.means_only(F.array(*[F.lit(x) for x in v]))) == readings


def test_groups_and_truncation(spark):
    v = F.array(*[F.lit(float(i)) for i in range(6)])
    assert one(spark, vectors.channel_groups(v, [2, 1, 3])) == [[0.0, 1.0], [2.0], [3.0, 4.0, 5.0]]
    assert one(spark, vectors.truncate(v, 2)) == [0.0, 1.0]
    assert len(one(spark, vectors.truncate(v, 99))) == 6


def test_percent_text(spark):
    assert one(spark, text.delta_text(F.lit(0.05))) == "+5.0% vs previous entry"
    assert one(spark, text.delta_text(F.lit(None).cast("double"))) == "No previous entry yet"
    assert one(spark, text.percent(F.lit(0.12345), 2)) == 12.35 or one(spark, text.percent(F.lit(0.12345), 2)) == 12.34
    assert one(spark, text.css_slug(F.lit("High Stress"))) == "high-stress"


def test_natural_order_of_long_numbers(spark):
    ids = ["S" + "9" * 20 + "12", "S" + "9" * 20 + "13", "S2", "S010", "S"]
    df = spark.createDataFrame([(i,) for i in reversed(ids)], "s string").orderBy(text.natural_key(F.col("s")))
    assert [r.s for r in df.collect()] == ["S", "S2", "S010", ids[0], ids[1]]


def test_times_do_not_depend_on_the_session_zone(spark):
    row = spark.range(1).select(F.timestamp_seconds(F.lit(0)).alias("t"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", name)
            got = row.select(text.iso_utc(F.col("t")).alias("iso"), F.unix_seconds(text.history_bound(F.lit("1970-01-01T00:00"))).alias("utc"),
                             F.unix_seconds(text.history_bound(F.lit("1970-01-01T00:00:00"), zone="America/New_York")).alias("ny")).first()
            assert tuple(got) == ("1970-01-01T00:00:00Z", 0, 18000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_shared_folder_is_required_on_a_cluster():
    from sensorloom.session import is_local, shared_dir

    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "local-cluster[3,2,3000]"
            getCheckpointDir = staticmethod(lambda: None)

    assert is_local("local[4]") and is_local("local") and not is_local("yarn")
    with pytest.raises(ValueError):
        shared_dir(Session, "x")


def test_sensor_thresholds_are_broadcast(spark):
    """Joined by sensor, all readings of a sensor would be read by one task."""
    from sensorloom.operators import sensors

    readings = spark.range(40).select(F.when(F.col("id") < 99, "Chest EDA").alias("sensor"), F.col("id").cast("double").alias("value"))
    judged = sensors.with_band(readings, schema.sensor_dim(spark))
    plan = judged._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {r.band: r["count"] for r in judged.groupBy("band").count().collect()} == {"baseline": 6, "stress": 1, "critical": 33}
