import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom import schema
from sensorloom.operators import history
from sensorloom.sources import models, recordings, stores

RNG = np.random.default_rng(42)


def fake_tables(spark, path, subjects=("S2", "S10"), seconds=6):
    """Chest at 700 Hz with labels cycling 1, 2, 3 and wrist streams at their own rates."""
    import pandas as pd

    def frame(n, cols):
        out = []
        for s in subjects:
            pdf = pd.DataFrame({c: RNG.normal(size=(n, 3)).astype("float32").tolist() if c == "ACC" else RNG.normal(size=n).astype("float32") for c in cols})
            pdf.insert(0, "idx", range(n))
            pdf.insert(0, "subject_id", s)
            out.append(pdf)
        return pd.concat(out, ignore_index=True)

    chest = frame(700 * seconds, ["ACC", "ECG", "EMG", "EDA", "Temp", "Resp"])
    chest["label"] = (chest["idx"] % 4).astype("int32")
    wrist = {}
    for name, (rate, _) in schema.SENSOR_RATES.items():
        part = name.split("_")[1].upper()
        pdf = frame(rate * seconds, [part])
        wrist[name] = spark.createDataFrame(pdf)
    recordings.write_tables(spark.createDataFrame(chest), wrist, path)
    return chest


def test_recording_end_to_end(spark, tmp_path):
    chest = fake_tables(spark, str(tmp_path))
    streams = recordings.read_tables(spark, str(tmp_path))
    df = recordings.labelled_samples(*streams)
    assert df.columns[-1] == "pos" and set(schema.CHANNELS) <= set(df.columns)
    got = df.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("top")).collect()
    assert {r.subject_id: (r.n, r.top) for r in got} == {s: (3150, 3149) for s in ("S2", "S10")}
    # Temperature passes the filter bank and the label filter unchanged.
    want = chest[(chest.subject_id == "S2") & (chest.label > 0)]["Temp"].to_numpy()
    mine = df.where("subject_id = 'S2'").orderBy("pos").toPandas()["Chest Temp"].to_numpy()
    assert np.allclose(mine, want)


def test_reading_one_subject_prunes(spark, tmp_path, capsys):
    fake_tables(spark, str(tmp_path), seconds=1)
    chest, _ = recordings.read_tables(spark, str(tmp_path), ["S10"])
    assert [r[0] for r in chest.select("subject_id").distinct().collect()] == ["S10"]
    chest.explain("formatted")
    assert "PartitionFilters: [" in capsys.readouterr().out


def test_missing_parts_are_named(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([(1, 2.0)], "idx long, ECG double")
    need = T.StructType([T.StructField("idx", T.LongType()), T.StructField("EDA", T.DoubleType())])
    with pytest.raises(recordings.RecordingError, match="EDA"):
        recordings.check_schema(df, need)
    rows = spark.createDataFrame([("a", "ECG"), ("a", "EDA"), ("b", "ECG")], "subject_id string, sensor string")
    got = {r.subject_id: (r.missing, r.error) for r in recordings.missing_sensors(rows, ["ECG", "EDA"]).collect()}
    assert got["a"] == ([], None) and got["b"][0] == ["EDA"] and "'EDA'" in got["b"][1]


def test_directory_scan(spark, tmp_path):
    with pytest.raises(recordings.RecordingError):
        recordings.read_directory(spark, str(tmp_path), schema=None)
    for s in ("S2", "S3"):
        (tmp_path / s).mkdir()
        (tmp_path / s / f"{s}.json").write_text('{"x": 1}\n{"x": 2}\n')
    df = recordings.read_directory(spark, str(tmp_path), "json")
    assert {r.subject_id: r["count"] for r in df.groupBy("subject_id").count().collect()} == {"S2": 2, "S3": 2}


def test_feature_cache_replaces_one_subject(spark, tmp_path, capsys):
    path = str(tmp_path / "features")
    df = spark.createDataFrame([("S2", [1.0], 1), ("S3", [2.0], 2)], "subject_id string, features array<double>, label int")
    stores.save_features(df, path)
    stores.save_features(spark.createDataFrame([("S3", [9.0], 3)], df.schema), path)
    back = {r.subject_id: (r.features, r.label) for r in stores.load_features(spark, path, schema=df.schema).collect()}
    assert back == {"S2": ([1.0], 1), "S3": ([9.0], 3)}
    one = stores.load_features(spark, path, ["S3"], schema=df.schema)
    one.explain("formatted")
    assert "PartitionFilters: [isnotnull(subject_id" in capsys.readouterr().out


def versions(spark, rows):
    df = spark.createDataFrame(rows, "subject_id string, v long, ratio double")
    return stores.document(df, version=F.col("v"), cols=["ratio"])


def test_upsert_and_delete(spark):
    docs = versions(spark, [("a", 1, 0.1), ("a", 2, 0.2), ("b", 1, 0.5), ("c", 3, 0.7)])
    gone = stores.tombstones(spark.createDataFrame([("c",)], "subject_id string"), F.lit(3).cast("long"))
    again = versions(spark, [("d", 9, 0.9)])
    live = stores.decode(stores.current(docs.unionByName(gone).unionByName(again)), "ratio double")
    assert {r.subject_id: r.ratio for r in live.collect()} == {"a": 0.2, "b": 0.5, "d": 0.9}


def test_comparison_lifetime(spark):
    df = spark.createDataFrame([("a", "2026-01-01 10:00:00"), ("b", "2026-01-01 08:59:59"), ("c", "2026-01-01 09:00:00")], "subject_id string, t string")
    docs = stores.document(df, version=F.to_timestamp("t"))
    got = stores.comparison(docs, F.to_timestamp(F.lit("2026-01-01 10:00:00")))
    assert {r.subject_id: r.served_from for r in got.collect()} == {"a": "memory", "b": "store", "c": "memory"}


def test_catalog_and_cascade(spark):
    def ids(*v):
        return spark.createDataFrame([(x,) for x in v], "subject_id string")

    listed = [r[0] for r in stores.subjects_with_models(ids("S10", "S2", "general", "general_manual", "S2")).collect()]
    assert listed == ["S2", "S10"]
    flags = {r.subject_id: (r.has_model, r.has_cache) for r in stores.saved_files(ids("a", "b"), ids("a", "a"), ids("b")).collect()}
    assert flags == {"a": (True, False), "b": (False, True)}
    left = stores.delete_cascade(ids("a"), {"files": ids("a", "b"), "results": ids("a")})
    assert [r[0] for r in left["files"].collect()] == ["b"] and left["results"].count() == 0


def test_csv_and_json_sinks(spark, tmp_path):
    row = [("T1", "2026-03-17T12:00:00Z", "S2", "manual input", True, 0.55, "High Stress", True, "Stress", 1, {"Stress": 1})]
    df = spark.createDataFrame(row, "tracking_id string, captured_at string, subject_id string, method string, is_manual boolean, stress_ratio double, "
                                    "stress_level string, overall_stress boolean, predicted_label string, total_windows long, label_counts map<string,long>")
    stores.write_csv(df, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*")).splitlines()
    assert text[0] == ",".join(schema.HISTORY_COLUMNS)
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert back.is_manual == "True" and json.loads(back.label_counts) == {"Stress": 1}
    stores.write_results(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().result.stress_level == "High Stress"
    assert history.csv_frame(df).columns == schema.HISTORY_COLUMNS


def test_registry(spark, tmp_path):
    rows = spark.createDataFrame([("a", 159), ("b", 64)], "model_id string, n_features int")
    assert [r.model_id for r in models.fresh_models(rows).collect()] == ["a"]


def test_recordings_are_filtered_and_joined_once(spark, monkeypatch):
    """Numbering a guessed size in blocks would run the whole path up to it three times."""
    from sensorloom.operators import filters
    from sensorloom.sources import recordings

    runs = spark.sparkContext.accumulator(0)
    plain = filters.zero_phase
    monkeypatch.setattr(filters, "zero_phase", lambda *a: (runs.add(1), plain(*a))[1])
    chest = spark.range(200).select((F.col("id") % 2).cast("string").alias("subject_id"), F.floor(F.col("id") / 2).alias("idx"), F.sin("id").alias("Chest ECG"), F.lit(1).alias("label"))
    wrist = spark.range(60).select((F.col("id") % 2).cast("string").alias("subject_id"), F.floor(F.col("id") / 2).alias("idx"), F.cos("id").alias("Wrist EDA"))
    out = recordings.labelled_samples(chest.repartition(2), [wrist])
    assert out.count() == 200
    assert runs.value == 2
