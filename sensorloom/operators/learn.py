"""Classifiers on window features: catalogue, fitting, evaluation, comparison, scoring.

Single trees and linear learners are MLlib's. Where MLlib has no counterpart the catalogue has its own: boosting is softmax boosting of
histogram trees (:mod:`boost`), forests have a least node size to split and grow for all folds in one job (:mod:`forest`), the kernel SVM is solved
exactly by a cascade (:mod:`svm`), nearest neighbours score by the exact join of :mod:`knn_join`, on streams or with parameter ``most`` against the bounded matrix of :mod:`knn`.
All are fitted on all rows unless parameter ``most`` asks for a sample. Models that grow with the rows stay in the shared folder.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, LogisticRegression,
)
from pyspark.ml.feature import ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions import labels as L
from sensorloom.functions.clean import impute, sanitize_features
from sensorloom.functions.vectors import means_only, truncate
from sensorloom.operators import boost, forest, knn, knn_join, metrics, scaling, splits, svm
from sensorloom.session import materialise
from sensorloom.sources import models as store

SEED = 42

# The catalogue's published parameters, in catalogue order.
CATALOGUE: dict[str, dict] = {
    "Random Forest": {"trees": 300, "depth": 25, "min_split": 5, "min_leaf": 2, "balanced": True},
    "SVM": {"C": 10.0, "balanced": True},
    "KNN": {"k": 5},
    "Decision Tree": {"depth": 20, "balanced": True},
    "Gradient Boosting": {"rounds": 200, "depth": 5, "rate": 0.1},
    "Logistic Regression": {"C": 1.0, "rounds": 1000, "balanced": True},
    "LightGBM": {"rounds": 300, "depth": 8, "leaves": 63, "rate": 0.1, "rows": 0.8, "columns": 0.8},
}
BOOSTED = ("Gradient Boosting", "LightGBM")
GROWERS = {"Random Forest": forest, "SVM": svm, **dict.fromkeys(BOOSTED, boost)}  # own learners: all folds in one job
DEFAULT = "Random Forest"
SELECTOR = {"trees": 100, "depth": 15, "share_of_mean": 0.5, "min_kept": 20, "min_width": 30}


@dataclass
class Fitted:
    """A fitted classifier: how to score, and what it was fitted on."""

    name: str
    labels: list[int]
    width: int
    pipeline: PipelineModel | None = None
    extra: dict = field(default_factory=dict)
    train: DataFrame | None = None  # nearest neighbours keep their training table
    seconds: float = 0.0

    def score(self, rows: DataFrame, row_id: str) -> DataFrame:
        """Add ``prediction`` (a label) and ``probability`` (in label order)."""
        cut = rows.withColumn("features", sanitize_features(truncate(F.col("features"), self.width)))
        if "kept" in self.extra:
            kept = F.array(*[F.lit(i) for i in self.extra["kept"]])
            cut = cut.withColumn("features", F.transform(kept, lambda i: F.get("features", i)))
        if self.train is not None:
            return self._vote(cut, row_id)
        df = self.pipeline.transform(_vectors(cut))
        if "boost" in self.extra:
            return self._voted(df, boost.scorer(self.extra["boost"]))
        if "forest" in self.extra and rows.isStreaming:  # a stream's rows can't meet a table by group
            return self._voted(df, forest.scorer(rows.sparkSession, forest.fetched(self.extra["forest"]), len(self.labels)))
        if "forest" in self.extra:
            own = _numbered(df)
            return with_prediction(_told(own, forest.chances(self.extra["forest"], own, "__at", F.col("__v"), len(self.labels)), "probability"), self.labels)
        if "svm" in self.extra and not rows.isStreaming and isinstance(self.extra["svm"]["vectors"], DataFrame):
            m, own = self.extra["svm"], _numbered(df)
            told = svm.judged(m["machines"], svm.Stored(m["vectors"], 0, m["classes"], 1.0, False), own, "__at", F.col("__v"))
            return with_prediction(_told(own, told, "probability", "votes"), self.labels, "votes").drop("votes")
        if "svm" in self.extra:
            told = df.withColumn("__v", svm.scorer(rows.sparkSession, self._svm())(vector_to_array("scaled")))
            told = told.withColumns({"probability": F.col("__v.probability"), "votes": F.col("__v.votes")})
            return with_prediction(told, self.labels, "votes").drop("__v", "votes", "__x", "__c", "scaled")
        raw = vector_to_array("probability")
        order = F.array(*[F.lit(c) for c in self.labels])
        drop = [c for c in ("__x", "__c", "scaled", "rawPrediction") if c in df.columns]
        return df.withColumns({
            "probability": raw, "prediction": F.element_at(order, F.col("prediction").cast("int") + 1),
        }).drop(*drop)

    def _svm(self) -> dict:
        """The kernel machines on the driver, for streams; so are those of models that were stored as one cell."""
        m = self.extra["svm"]
        return svm.fetched(m) if isinstance(m["vectors"], DataFrame) else m

    def _vote(self, rows: DataFrame, row_id: str) -> DataFrame:
        scaled = self.pipeline.transform(_vectors(rows))
        if not self.extra["most"] and not rows.isStreaming:
            own = _numbered(scaled)
            found = knn_join.neighbours(self.train, own, self.extra["k"], train_id="tid", query_id="__at", vector="__v")
            return _told(own, knn.vote(found, self.labels).withColumnRenamed("qid", "__at"), "prediction", "probability")
        found = knn.judge(self.train, vector_to_array("scaled"), self.extra["k"], self.labels, train_id="tid", train_vector="__v", most=self.extra["most"] or knn.MAX_TRAIN_ROWS)
        told = scaled.withColumn("__v", found)
        return told.withColumns({"prediction": F.col("__v.prediction"), "probability": F.col("__v.probability")}).drop("__v", "__x", "__c", "scaled")

    def _voted(self, df: DataFrame, score: Callable[[Column], Column]) -> DataFrame:
        return with_prediction(df.withColumn("probability", score(vector_to_array("scaled"))), self.labels).drop("__x", "__c", "scaled")

    def importances(self) -> DataFrame | None:
        """(pos, importance), or None when the classifier has none."""
        if "boost" in self.extra:
            return SparkSession.active().createDataFrame(list(enumerate(self.extra["boost"]["gains"])), "pos long, importance double")
        if "forest" in self.extra:
            return forest.shares(self.extra["forest"])
        last = self.pipeline.stages[-1] if self.pipeline else None
        if last is None or not hasattr(last, "featureImportances"):
            return None
        spark = SparkSession.active()
        values = last.featureImportances.toArray()  # one number per feature
        return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "pos long, importance double")


def _numbered(df: DataFrame) -> DataFrame:
    """The rows to be scored, written once under a number of their own, as ids may repeat or be null: ``__at``, and the scaled vector as ``__v``."""
    own = df.withColumns({"__v": vector_to_array("scaled"), "__at": F.monotonically_increasing_id()})
    return materialise(own.drop("__x", "__c", "scaled"), "scoring")


def _told(own: DataFrame, told: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``told`` beside the numbered rows that they belong to."""
    return own.join(told.select("__at", *columns), "__at").drop("__at", "__v")


def with_prediction(scored: DataFrame, labels: list[int], by: str = "probability") -> DataFrame:
    """The label with the largest probability (or votes), the first of several."""
    order, best = F.array(*[F.lit(c) for c in labels]), F.array_position(by, F.array_max(by))
    return scored.withColumn("prediction", F.element_at(order, best.cast("int")))


# --- Preparation -------------------------------------------------------------------------------


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__x", array_to_vector(F.transform("features", lambda v: impute(v))))


def label_index(labels: list[int], label: Column) -> Column:
    """MLlib wants 0-based classes; the order is the sorted labels, never the frequency."""
    return (F.array_position(F.array(*[F.lit(c) for c in labels]), label) - 1).cast("double")


def distinct_labels(rows: DataFrame, label: str = "label") -> list[int]:
    """The classes present: a handful of values."""
    return sorted(r[0] for r in rows.select(label).distinct().collect())


def _scaler_stages(n: int, width: int) -> list:
    """Population standardisation: MLlib's scaler divides by the sample deviation, so correct it."""
    factor = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    return [
        StandardScaler(inputCol="__x", outputCol="__c", withMean=True, withStd=True),
        ElementwiseProduct(inputCol="__c", outputCol="scaled", scalingVec=Vectors.dense([factor] * width)),
    ]


# --- Learners ----------------------------------------------------------------------------------


def _tree(p: dict, weight: str | None):
    est = DecisionTreeClassifier(featuresCol="scaled", labelCol="__y", maxDepth=p["depth"], seed=SEED)
    return est.setWeightCol(weight) if weight else est


def _logistic(p: dict, weight: str | None, n: int):
    est = LogisticRegression(
        featuresCol="scaled", labelCol="__y", maxIter=p["rounds"], regParam=1.0 / (p["C"] * n), elasticNetParam=0.0,
        standardization=False, family="multinomial")
    return est.setWeightCol(weight) if weight else est


def fit(rows: DataFrame, name: str, params: dict | None = None, *, label: str = "label", row_id: str = "vec_id") -> Fitted:
    """Impute, standardise, fit. An unknown name means the default classifier."""
    name = name if name in CATALOGUE else DEFAULT
    p = {**CATALOGUE[name], **(params or {})}
    started = time.time()
    labels = distinct_labels(rows, label)
    data = _vectors(rows.withColumn("features", sanitize_features(F.col("features"))))
    data = data.withColumn("__y", label_index(labels, F.col(label)))
    weight = None
    if p.get("balanced"):
        weight = "__w"
        data = scaling.with_class_weight(data, label, weight)
    n, width = data.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    stages = _scaler_stages(n, width)
    fitted = Fitted(name, labels, width)

    if name == "KNN":
        fitted.pipeline = Pipeline(stages=stages).fit(data)
        scaled = fitted.pipeline.transform(data)
        fitted.train = scaled.select(F.col(row_id).alias("tid"), F.col(label).alias("label"), vector_to_array("scaled").alias("__v"))
        fitted.extra = {"k": p["k"], "most": p.get("most")}
    elif name in GROWERS:
        fitted.pipeline = Pipeline(stages=stages).fit(data)
        scaled = fitted.pipeline.transform(data)
        kind = {"SVM": "svm", "Random Forest": "forest"}.get(name, "boost")
        make = boost.fit if kind == "boost" else GROWERS[name].fit_table
        fitted.extra = {kind: make(scaled, row_id, vector_to_array("scaled"), F.col("__y"), len(labels), width, p)}
    else:
        learner = {
            "Decision Tree": lambda: _tree(p, weight),
            "Logistic Regression": lambda: _logistic(p, weight, n),
        }[name]()
        fitted.pipeline = Pipeline(stages=[*stages, learner]).fit(data)
    fitted.seconds = round(time.time() - started, 3)
    return fitted


def _in_parallel(spark: SparkSession, task: Callable, items: list, parallelism: int = 4) -> list:
    """Run independent fits as concurrent Spark jobs, results in the order of the items."""
    with ThreadPool(max(1, min(parallelism, len(items)))) as pool:
        return pool.map(inheritable_thread_target(spark)(task), items)


# --- Evaluation --------------------------------------------------------------------------------


def evaluate(scored: DataFrame, labels: list[int], label: str = "label") -> DataFrame:
    """One row of figures from scored rows."""
    rows = scored.select(F.col(label).alias("actual"), F.col("prediction").alias("predicted"), "probability")
    overall = metrics.overall_scores(metrics.class_scores(metrics.confusion(rows)))
    names = {c: f"p_{c}" for c in labels}
    wide = rows.select("actual", *[F.get("probability", F.lit(i)).alias(names[c]) for i, c in enumerate(labels)])
    auc = metrics.roc_auc(wide, names).select("roc_auc").scalar()
    return overall.withColumn("roc_auc", auc)


def cross_validate(rows: DataFrame, name: str, params: dict | None, folds: int, *, label: str = "label", row_id: str = "vec_id") -> DataFrame:
    """(fold, accuracy) with a fresh fit per fold on a table written once."""
    dealt = materialise(splits.kfold(rows, label, [row_id], folds=folds), "folds")
    if name in GROWERS:
        return _hits(_left_out(dealt, "fold", name, params, label, row_id))

    def one(i: int) -> DataFrame:
        model = fit(dealt.where(F.col("fold") != i), name, params, label=label, row_id=row_id)
        return model.score(dealt.where(F.col("fold") == i), row_id).select("fold", F.col(label).alias("actual"), F.col("prediction").alias("predicted"))

    from sensorloom.sources.recordings import union_subjects

    parts = _in_parallel(rows.sparkSession, one, list(range(folds)))

    return _hits(union_subjects(parts))


def _hits(out: DataFrame) -> DataFrame:
    return out.groupBy("fold").agg(F.avg(F.when(F.col("actual") == F.col("predicted"), 1.0).otherwise(0.0)).alias("accuracy"))


def _left_out(table: DataFrame, fold: str, name: str, params: dict | None, label: str, row_id: str) -> DataFrame:
    """(``fold``, actual, predicted) of every row by a model fitted without its fold; all models in the same jobs. Trees need no scaling, kernel machines scale for themselves."""
    labels = distinct_labels(table, label)
    clean = table.withColumn("features", F.transform(sanitize_features(F.col("features")), lambda v: impute(v)))
    width = clean.agg(F.max(F.size("features"))).first()[0]
    scored = GROWERS[name].fit_leaving_out(clean, fold, row_id, F.col("features"), label_index(labels, F.col(label)), len(labels), width, {**CATALOGUE[name], **(params or {})})
    told = with_prediction(scored, labels, "votes" if "votes" in scored.columns else "probability").select(row_id, F.col("prediction").alias("predicted"))
    return table.select(row_id, F.col(fold), F.col(label).alias("actual")).join(told, row_id).drop(row_id)


def select_features(rows: DataFrame, params: dict | None = None, *, label: str = "label", row_id: str = "vec_id") -> list[int]:
    """Positions a forest finds important enough; all of them when too few survive. The importance
    vector has one entry per feature."""
    p = {**SELECTOR, **(params or {})}
    model = fit(rows, "Random Forest", {"trees": p["trees"], "depth": p["depth"], "min_split": 2, "min_leaf": 1, "balanced": False}, label=label, row_id=row_id)
    values = [r.importance for r in forest.shares(model.extra["forest"]).orderBy("pos").collect()]
    kept = [i for i, v in enumerate(values) if v >= p["share_of_mean"] * sum(values) / len(values)]
    return kept if len(kept) >= p["min_kept"] else list(range(len(values)))


def train_eval(
    rows: DataFrame, name: str = DEFAULT, params: dict | None = None, *, test_size: float = 0.2, cv_folds: int = 5,
    feature_selection: bool = False, label: str = "label", row_id: str = "vec_id",
) -> tuple[Fitted, DataFrame, DataFrame]:
    """Split, fit, evaluate, cross-validate. Returns the model, one metrics row, the scored test rows."""
    name = name if name in CATALOGUE else DEFAULT
    rows = materialise(rows, "rows")
    parted = materialise(splits.stratified(rows, label, [row_id], test_size=test_size), "split")
    train, test = parted.where(~F.col("is_test")), parted.where("is_test")
    width = train.agg(F.max(F.size("features"))).first()[0]
    kept = None
    if feature_selection and width > SELECTOR["min_width"]:
        kept = select_features(train, label=label, row_id=row_id)
        kept = None if len(kept) == width else kept
    model = fit(_keep(train, kept), name, params, label=label, row_id=row_id)
    model.labels = model.labels or distinct_labels(rows, label)
    if kept is not None:
        model = replace(model, width=width, extra={**model.extra, "kept": kept})
    scored = materialise(model.score(test, row_id).select(row_id, label, "prediction", "probability"), "scored")
    row = evaluate(scored, model.labels, label)
    cv = metrics.fold_summary(cross_validate(_keep(rows, kept), name, params, cv_folds, label=label, row_id=row_id)) if cv_folds else None
    row = row.withColumns({
        "cv_mean": cv.select("cv_mean").scalar() if cv is not None else F.lit(0.0),
        "cv_std": cv.select("cv_std").scalar() if cv is not None else F.lit(0.0),
        "train_time_sec": F.lit(model.seconds), "classifier_name": F.lit(name),
        "n_features_used": F.lit(len(kept) if kept is not None else width), "feature_selection_applied": F.lit(kept is not None),
    })
    return model, row, scored


def _keep(rows: DataFrame, kept: list[int] | None) -> DataFrame:
    if kept is None:
        return rows
    return rows.withColumn("features", F.transform(F.array(*[F.lit(i) for i in kept]), lambda i: F.get("features", i)))


FIGURES = ["accuracy", "f1_weighted", "f1_macro", "precision", "recall", "roc_auc", "cv_mean", "cv_std", "train_time_sec"]


def compare(rows: DataFrame, names: list[str] | None = None, params: dict[str, dict] | None = None, **kw) -> DataFrame:
    """Every classifier on the same rows, ranked. A failing one keeps a zero row with its error."""
    from sensorloom.sources.recordings import union_subjects

    spark = rows.sparkSession
    rows = materialise(rows, "rows")

    def one(entry: tuple[int, str]) -> DataFrame:
        i, name = entry
        try:
            _, row, _ = train_eval(rows, name, (params or {}).get(name), **kw)
            out = row.select(F.lit(i).alias("catalogue_idx"), "classifier_name", *FIGURES, F.lit(None).cast("string").alias("error"))
            return materialise(out, "metrics")
        except Exception as exc:  # one classifier must not end the comparison
            schema = "catalogue_idx int, classifier_name string, " + ", ".join(f"{f} double" for f in FIGURES) + ", error string"
            zeros = [None if f == "roc_auc" else 0.0 for f in FIGURES]
            return spark.createDataFrame([(i, name, *zeros, str(exc))], schema)

    frames = _in_parallel(spark, one, list(enumerate(names or list(CATALOGUE))))
    return metrics.rank_models(union_subjects(frames).withColumn("__all", F.lit(0)), ["__all"]).drop("__all")


def leave_one_subject_out(rows: DataFrame, name: str = DEFAULT, params: dict | None = None, *, subject: str = "subject_id",
                          label: str = "label", row_id: str = "vec_id") -> DataFrame:
    """Out-of-fold rows (subject, actual, predicted): over one written table. Own learners fit all models in one job, others one after the other."""
    from sensorloom.sources.recordings import union_subjects

    table = materialise(rows, "loso")
    if name in GROWERS:
        return materialise(_left_out(table, subject, name, params, label, row_id), "oof")

    def one(held_out: str) -> DataFrame:
        train, test = splits.leave_one_out(table, held_out, subject)
        model = fit(train, name, params, label=label, row_id=row_id)
        return model.score(test, row_id).select(subject, F.col(label).alias("actual"), F.col("prediction").alias("predicted"))

    subjects = sorted(r[0] for r in table.select(subject).distinct().collect())  # one fit each, so few
    parts = _in_parallel(rows.sparkSession, one, subjects)
    return materialise(union_subjects(parts), "oof")


@dataclass
class General:
    """The subject-independent model, its means-only companion and their figures."""

    model: Fitted
    metrics: DataFrame
    loso: DataFrame | None
    manual: Fitted
    manual_metrics: DataFrame


def train_general(rows: DataFrame, name: str = DEFAULT, params: dict | None = None, *, cv_folds: int = 5, n_channels: int = 14,
                  manual_params: dict | None = None, label: str = "label", row_id: str = "vec_id") -> General:
    """Fit on all subjects, evaluate leaving subjects out (three or more), fit the means-only model."""
    model, row, _ = train_eval(rows, name, params, cv_folds=cv_folds, label=label, row_id=row_id)
    totals = rows.agg(F.countDistinct("subject_id").alias("s"), F.count(F.lit(1)).alias("w"))
    n_subjects, n_windows = totals.first()
    row = row.withColumns({"n_subjects": F.lit(n_subjects), "n_windows_total": F.lit(n_windows)})
    loso = leave_one_subject_out(rows, name, params, label=label, row_id=row_id) if n_subjects >= 3 else None
    manual, manual_row = train_manual(rows, manual_params, n_channels=n_channels, label=label, row_id=row_id)
    return General(model, row, loso, manual, manual_row)


def train_manual(rows: DataFrame, params: dict | None = None, *, n_channels: int = 14, label: str = "label",
                 row_id: str = "vec_id") -> tuple[Fitted, DataFrame]:
    """Forest on the channel means alone, without class weights."""
    compact = rows.withColumn("features", means_only(F.col("features"), n_channels))
    model, row, _ = train_eval(compact, DEFAULT, {"balanced": False, **(params or {})}, cv_folds=0, label=label, row_id=row_id)
    return model, row


# --- Scoring and storing -----------------------------------------------------------------------


def predict(model: Fitted, rows: DataFrame, row_id: str, subject: str = "subject_id") -> DataFrame:
    """Label, name, stress flag per row, and P(stress) for the only row of a subject."""
    scored = model.score(rows, row_id)
    sizes = rows.groupBy(subject).agg(F.count(F.lit(1)).alias("__n"))
    return scored.join(sizes, subject).withColumns({
        "label_name": L.label_name(F.col("prediction")), "is_stressed": L.is_stressed(F.col("prediction")),
        "stress_confidence": F.when(F.col("__n") == 1, stress_probability(model.labels)),
    }).drop("__n")


def stress_probability(labels: list[int]) -> Column:
    """P(stress) of a scored row, NULL for a model that does not know the class."""
    if 2 not in labels:
        return F.lit(None).cast("double")
    return F.get("probability", F.lit(labels.index(2)))


def save(model: Fitted, root: str, model_id: str) -> None:
    """Pipeline, description and, for nearest neighbours, the training table."""
    store.save(model.pipeline, root, model_id, model.width, model.name)
    path = store.model_path(root, model_id)
    extra = {k: v for k, v in model.extra.items() if k not in ("svm", "forest")}
    if "svm" in model.extra:
        extra["svm"] = {k: v for k, v in model.extra["svm"].items() if k not in ("machines", "y", "vectors")}
    about = json.dumps({"name": model.name, "labels": model.labels, "width": model.width, "extra": extra})
    SparkSession.active().createDataFrame([(about,)], "about string").write.mode("overwrite").text(f"{path}/about")
    if model.train is not None:
        model.train.write.mode("overwrite").parquet(f"{path}/train")
    if "forest" in model.extra:
        model.extra["forest"].write.mode("overwrite").parquet(f"{path}/trees")
    if "svm" in model.extra:
        model.extra["svm"]["machines"].write.mode("overwrite").parquet(f"{path}/svm")
        model.extra["svm"]["vectors"].write.mode("overwrite").parquet(f"{path}/svm_rows")


def load(root: str, model_id: str) -> Fitted:
    spark = SparkSession.active()
    path = store.model_path(root, model_id)
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    model = Fitted(about["name"], about["labels"], about["width"], store.load(root, model_id), about["extra"])
    if model.name == "KNN":
        model.train = spark.read.parquet(f"{path}/train")
    if model.name == "Random Forest":
        trees = spark.read.parquet(f"{path}/trees")
        model.extra["forest"] = trees if "packed" in trees.columns else forest.packed(trees)
    if model.name == "SVM":
        made = spark.read.parquet(f"{path}/svm")
        if "svm" in model.extra:
            chunks = spark.read.parquet(f"{path}/svm_rows")
            model.extra["svm"] |= {"machines": made, "y": chunks, "vectors": chunks}
        else:  # stored as one cell
            model.extra["svm"] = json.loads(made.first()["model"])
    return model
