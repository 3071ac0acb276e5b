"""Schemas, dimensions and fixed values of the wearable-recording domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- Fixed values: they must equal the published ones for results to agree ---------------------

CHEST_CHANNELS = [
    "Chest Acc X", "Chest Acc Y", "Chest Acc Z", "Chest ECG",
    "Chest EMG", "Chest EDA", "Chest Temp", "Chest Resp",
]
WRIST_CHANNELS = [
    "Wrist Acc X", "Wrist Acc Y", "Wrist Acc Z",
    "Wrist BVP", "Wrist EDA", "Wrist Temp",
]
CHANNELS = CHEST_CHANNELS + WRIST_CHANNELS

LABEL_NAMES = {1: "Baseline", 2: "Stress", 3: "Amusement"}
STRESS_LABELS = [2]
BASELINE_LABEL = 1
STRESS_LABEL = 2

SAMPLE_RATE_HZ = 700
WINDOW_SECONDS = 5
OVERLAP = 0.5

TIME_STATS = ["mean", "std", "min", "max", "median", "iqr", "skew", "kurtosis"]
SPECTRAL_STATS = ["dom_freq", "spectral_energy", "spectral_entropy"]
HRV_STATS = ["hrv_rmssd", "hrv_sdnn", "hrv_mean_rr", "hrv_pnn50", "hrv_hr"]

# Resting HRV assumed for a single typed-in reading, in HRV_STATS order.
MANUAL_HRV = [30.0, 50.0, 800.0, 20.0, 75.0]
MANUAL_STD_SHARE = 0.08
MANUAL_IQR_SHARE = 0.07
MANUAL_EPSILON = 1e-6
MANUAL_MIN_SHARE = 0.9
MANUAL_MAX_SHARE = 1.1

# sensor, low (baseline centroid), high (stress centroid), critical
SENSOR_ROWS = [
    ("Chest Acc X", 0.77, 0.85, 0.89),
    ("Chest Acc Y", -0.049, -0.009, 0.01),
    ("Chest Acc Z", -0.391, -0.266, -0.20),
    ("Chest ECG", 0.00115, 0.00102, 0.00095),
    ("Chest EMG", -0.00292, -0.00291, -0.00314),
    ("Chest EDA", 3.9, 6.0, 7.0),
    ("Chest Temp", 33.4, 34.1, 34.5),
    ("Chest Resp", 0.056, 0.050, 0.046),
    ("Wrist Acc X", 14.3, 17.3, 19.0),
    ("Wrist Acc Y", -4.4, -9.4, -12.0),
    ("Wrist Acc Z", 12.4, 3.1, -2.0),
    ("Wrist BVP", 0.005, 0.018, 0.025),
    ("Wrist EDA", 1.3, 3.4, 4.5),
    ("Wrist Temp", 33.3, 32.7, 32.3),
]

# Ratio bands: (upper bound exclusive, level, colour, gauge class); the last has no bound.
RATIO_BANDS = [
    (0.20, "Low Stress", "#34d399", "gauge-low"),
    (0.40, "Moderate Stress", "#fbbf24", "gauge-moderate"),
    (0.65, "High Stress", "#f87171", "gauge-high"),
    (None, "Critical Stress", "#dc2626", "gauge-critical"),
]
SINGLE_BANDS = [
    (0.35, "Low Stress", "#34d399", "gauge-low"),
    (0.50, "Moderate Stress", "#fbbf24", "gauge-moderate"),
    (0.75, "High Stress", "#fbbf24", "gauge-high"),
    (None, "Critical Stress", "#dc2626", "gauge-critical"),
]
OVERALL_STRESS_RATIO = 0.30
TREND_DELTA = 0.02

HISTORY_COLUMNS = [
    "tracking_id", "captured_at", "subject_id", "method", "is_manual", "stress_ratio",
    "stress_level", "overall_stress", "predicted_label", "total_windows", "label_counts",
]
HISTORY_CAP = 500
RECENT_ENTRIES = 8
COMPARISON_TTL_SECONDS = 3600
RATE_LIMIT_REQUESTS = 10
RATE_LIMIT_SECONDS = 60

GENERAL_ID = "general"
GENERAL_MANUAL_ID = "general_manual"
MIN_MODEL_FEATURES = 100
TOP_IMPORTANCES = 15

# Protocol phases in minutes.
PHASES = [
    ("Base", 7.08, 26.32), ("TSST", 39.55, 50.30), ("Medi1", 70.19, 77.10),
    ("Fun", 81.25, 87.47), ("Medi2", 93.38, 100.15), ("sRead", 54.42, 56.07),
    ("fRead", 89.51, 91.15),
]

# channel -> (low edge or None, high edge) in Hz; channels not listed pass unchanged.
FILTER_BANK = {
    "Chest ECG": (0.5, 40.0),
    "Chest EMG": (20.0, 300.0),
    "Chest EDA": (None, 5.0),
    "Chest Resp": (None, 1.0),
}
FILTER_ORDER = 4
MIN_FILTER_SAMPLES = 30

# sensor table -> (rate in Hz, channels)
SENSOR_RATES = {
    "wrist_acc": (32, ["Wrist Acc X", "Wrist Acc Y", "Wrist Acc Z"]),
    "wrist_bvp": (64, ["Wrist BVP"]),
    "wrist_eda": (4, ["Wrist EDA"]),
    "wrist_temp": (4, ["Wrist Temp"]),
}
REQUIRED_SENSORS = {
    "chest": ["ACC", "ECG", "EMG", "EDA", "Temp", "Resp"],
    "wrist": ["ACC", "BVP", "EDA", "TEMP"],
}

METRIC_NAMES = ["accuracy", "f1_weighted", "f1_macro", "precision", "recall", "roc_auc", "cv_mean"]

# --- End of fixed values -----------------------------------------------------------------------


def feature_names(channels: list[str] | None = None) -> list[str]:
    """Names of the window features, all channels of one statistic before the next statistic."""
    channels = channels or CHANNELS
    per_channel = [f"{c}_{s}" for s in TIME_STATS + SPECTRAL_STATS for c in channels]
    return per_channel + [f"ECG_{s}" for s in HRV_STATS]


SENSOR_SCHEMA = T.StructType([
    T.StructField("sensor", T.StringType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("critical", T.DoubleType()),
])

CHEST_SCHEMA = T.StructType([
    T.StructField("subject_id", T.StringType()),
    T.StructField("idx", T.LongType()),
    T.StructField("ACC", T.ArrayType(T.FloatType())),
    *[T.StructField(s, T.FloatType()) for s in REQUIRED_SENSORS["chest"][1:]],
    T.StructField("label", T.IntegerType()),
])

HISTORY_SCHEMA = T.StructType([
    T.StructField("tracking_id", T.StringType()),
    T.StructField("captured_at", T.TimestampType()),
    T.StructField("subject_id", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("is_manual", T.BooleanType()),
    T.StructField("stress_ratio", T.DoubleType()),
    T.StructField("stress_level", T.StringType()),
    T.StructField("overall_stress", T.BooleanType()),
    T.StructField("predicted_label", T.StringType()),
    T.StructField("total_windows", T.LongType()),
    T.StructField("label_counts", T.MapType(T.StringType(), T.LongType())),
])


def sensor_dim(spark: SparkSession) -> DataFrame:
    """The 14-row sensor dimension (a fixed size, so joins on it may broadcast)."""
    return spark.createDataFrame(SENSOR_ROWS, SENSOR_SCHEMA)


def label_dim(spark: SparkSession) -> DataFrame:
    """The 3-row label dimension."""
    rows = [(k, v, k in STRESS_LABELS) for k, v in LABEL_NAMES.items()]
    return spark.createDataFrame(rows, "label int, name string, is_stress boolean")
