"""Bindings of the generic test tables to the domain, as DataFrames and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators import ordering, windows
from sensorloom.operators.windows import WindowSpec

SIG_FS = 4
SIG_SPEC = WindowSpec.of(2, SIG_FS, 0.5)
SIG4_SPEC = WindowSpec(32, 16)
SIG4_CHANNELS = ["quantity", "extendedprice", "discount", "tax"]
SIG4_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
FEAT_WIDTH = 64
EVENT_LABELS = {"error": 2, "click": 1, "view": 1, "purchase": 3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: str):
    """Microseconds since 1970 of a zone-less timestamp, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))


def sig(spark: SparkSession, sf_dir: str, valid_only: bool = False) -> DataFrame:
    """One-channel samples: events of a user. The optional filter is on the stored column, so it
    reaches the Parquet scan."""
    events = table(spark, sf_dir, "events")
    if valid_only:
        events = events.where(F.col("event_type").isin(*EVENT_LABELS))
    label = F.lit(0)
    for name, code in EVENT_LABELS.items():
        label = F.when(F.col("event_type") == name, code).otherwise(label)
    return events.select(F.col("user_id").alias("subject_id"), "event_id", "ts", F.col("value").alias("x"), label.alias("label"))


def sig_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.reindex(sig(spark, sf_dir, valid_only=True), ["ts", "event_id"], leading=epoch("ts"))


def sig4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-channel samples: line items of a supplier. Every row carries a valid label."""
    label = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("subject_id"), *SIG4_ORDER,
        *[F.col(f"l_{c}").alias(c) for c in SIG4_CHANNELS], label.alias("label"),
    )


def sig4_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windows.reindex(sig4(spark, sf_dir), SIG4_ORDER, leading=epoch("l_shipdate"))
    return df.select("subject_id", "pos", *SIG4_CHANNELS, "label")


def feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.concat(F.lit("S"), (F.col("vec_id") % 15 + 2).cast("string")).alias("subject_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        (F.col("label") % 3 + 1).alias("label"),
    )


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persistence forecast: the prediction is the previous label of the subject."""
    samples = sig(spark, sf_dir, valid_only=True)
    blocks, blocked = ordering.order_blocks(samples, epoch("ts"))
    lagged = ordering.previous_value(blocks, ["subject_id"], ["ts", "event_id"], {"label": "predicted"}, blocked=blocked)
    return lagged.where(F.col("predicted").isNotNull()).select(
        "subject_id", "event_id", F.col("label").alias("actual"), "predicted", F.col("x").alias("score"),
    )


def hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = (F.col("o_orderkey") * 37 % 1001) / 1000.0
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("tracking_id"),
        F.col("o_orderdate").alias("captured_at"), F.col("o_orderkey").alias("seq"),
        ratio.alias("stress_ratio"), F.col("o_orderpriority").startswith("1-").alias("is_manual"),
        F.when(ratio >= 0.5, "Stress").otherwise("Baseline").alias("predicted_label"),
        F.col("o_orderstatus").alias("subject_id"),
    )


def docl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary binding: labelled documents, score = length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


# --- The same bindings for the SQL checks ------------------------------------------------------

SIG_SQL = """sig AS (
  SELECT user_id AS subject_id, event_id, ts, value AS x,
         CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 1 WHEN 'view' THEN 1
                         WHEN 'purchase' THEN 3 ELSE 0 END AS label
  FROM events)"""

SIG_POS_SQL = """sig_pos AS (
  SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY ts, event_id) - 1 AS pos,
         count(*) OVER (PARTITION BY subject_id) AS n
  FROM sig WHERE label IN (1, 2, 3))"""

SIG_WIN_SQL = """sig_win AS (
  SELECT * FROM (
    SELECT *, unnest(generate_series(CASE WHEN pos < 8 THEN 0 ELSE (pos - 8) // 4 + 1 END, pos // 4)) AS window_id
    FROM sig_pos)
  WHERE window_id * 4 + 8 <= n)"""

SIG_LABEL_SQL = """sig_label AS (
  SELECT subject_id, window_id, label FROM (
    SELECT subject_id, window_id, label,
           row_number() OVER (PARTITION BY subject_id, window_id ORDER BY count(*) DESC, label) AS r
    FROM sig_win GROUP BY subject_id, window_id, label)
  WHERE r = 1)"""

SIG4_SQL = """sig4 AS (
  SELECT l_suppkey AS subject_id, l_shipdate, l_orderkey, l_linenumber, l_partkey,
         l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount, l_tax AS tax,
         CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS label
  FROM lineitem)"""

SIG4_POS_SQL = """sig4_pos AS (
  SELECT *, row_number() OVER (PARTITION BY subject_id
                               ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS pos,
         count(*) OVER (PARTITION BY subject_id) AS n
  FROM sig4)"""

SIG4_WIN_SQL = """sig4_win AS (
  SELECT * FROM (
    SELECT *, unnest(generate_series(CASE WHEN pos < 32 THEN 0 ELSE (pos - 32) // 16 + 1 END, pos // 16)) AS window_id
    FROM sig4_pos)
  WHERE window_id * 16 + 32 <= n)"""

SIG4_LONG_SQL = """sig4_long AS (
  SELECT subject_id, window_id, pos, label, 'quantity' AS channel, quantity AS x FROM sig4_win
  UNION ALL SELECT subject_id, window_id, pos, label, 'extendedprice', extendedprice FROM sig4_win
  UNION ALL SELECT subject_id, window_id, pos, label, 'discount', discount FROM sig4_win
  UNION ALL SELECT subject_id, window_id, pos, label, 'tax', tax FROM sig4_win)"""

FEAT_SQL = """feat AS (
  SELECT vec_id, 'S' || (vec_id % 15 + 2) AS subject_id, CAST(embedding AS DOUBLE[]) AS features,
         label % 3 + 1 AS label
  FROM embeddings)"""

PRED_SQL = """pred AS (
  SELECT subject_id, event_id, label AS actual, predicted, x AS score FROM (
    SELECT *, lag(label) OVER (PARTITION BY subject_id ORDER BY ts, event_id) AS predicted
    FROM sig WHERE label IN (1, 2, 3))
  WHERE predicted IS NOT NULL)"""

HIST_SQL = """hist AS (
  SELECT 'T' || o_custkey AS tracking_id, o_orderdate AS captured_at, o_orderkey AS seq,
         (o_orderkey * 37 % 1001) / 1000.0 AS stress_ratio, o_orderpriority LIKE '1-%' AS is_manual,
         CASE WHEN (o_orderkey * 37 % 1001) / 1000.0 >= 0.5 THEN 'Stress' ELSE 'Baseline' END AS predicted_label,
         o_orderstatus AS subject_id
  FROM orders)"""

DOCL_SQL = """docl AS (
  SELECT d.doc_id, d.n_chars, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

SIG_CTES = [SIG_SQL, SIG_POS_SQL]
SIG_WIN_CTES = [*SIG_CTES, SIG_WIN_SQL]
SIG_LABEL_CTES = [*SIG_WIN_CTES, SIG_LABEL_SQL]
SIG4_CTES = [SIG4_SQL, SIG4_POS_SQL]
SIG4_WIN_CTES = [*SIG4_CTES, SIG4_WIN_SQL]
SIG4_LONG_CTES = [*SIG4_WIN_CTES, SIG4_LONG_SQL]
PRED_CTES = [SIG_SQL, PRED_SQL]
