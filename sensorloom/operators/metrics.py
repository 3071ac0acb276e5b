"""Evaluation of predictions. Everything starts from the confusion cells, one partial aggregation
whose result has at most classes x classes rows per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorloom.functions import labels as L
from sensorloom.operators import ordering


def eval_rows(rows: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    """Keep rows whose truth is a target class; a prediction outside them reads ``Other``."""
    names = names or L.LABEL_NAMES
    return rows.where(F.col("actual").isin(*names)).withColumns({
        "actual_name": L.eval_name(F.col("actual"), names),
        "predicted_name": L.eval_name(F.col("predicted"), names),
    })


def confusion(rows: DataFrame, keys: list[str] = [], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Non-empty cells."""
    return rows.groupBy(
        *keys, F.col(actual).alias("actual"), F.col(predicted).alias("predicted"),
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_grid(cells: DataFrame, keys: list[str] = [], labels: list | None = None) -> DataFrame:
    """All cells over the union of labels (or an explicit list), zeros included."""
    seen = cells.select(*keys, F.explode(F.array("actual", "predicted")).alias("c"))
    per_key = seen.groupBy(*keys).agg(F.array_sort(F.collect_set("c")).alias("ls"))
    if labels is not None:
        per_key = per_key.withColumn("ls", F.array(*[F.lit(v) for v in labels]))
    grid = per_key.select(*keys, F.explode("ls").alias("actual"), "ls").select(
        *keys, "actual", F.explode("ls").alias("predicted"))
    joined = grid.join(cells, [*keys, "actual", "predicted"], "left")
    return joined.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def confusion_shade(grid: DataFrame, keys: list[str] = []) -> DataFrame:
    """Cells relative to the largest one."""
    top = F.max("n").over(W.partitionBy(*(keys or [F.lit(0)])))
    return grid.withColumn("shade", F.when(top > 0, F.col("n") / top).otherwise(F.lit(0.0)))


def class_scores(cells: DataFrame, keys: list[str] = []) -> DataFrame:
    """Precision, recall, F1 and support per class, 0 where undefined. No join: every cell adds to
    its true and to its predicted class."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    parts = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), zero.alias("guessed"), hit.alias("tp")),
        F.struct(F.col("predicted").alias("label"), zero.alias("support"), F.col("n").alias("guessed"), zero.alias("tp")),
    )
    sums = cells.select(*keys, F.inline(parts)).groupBy(*keys, "label").agg(
        F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("tp").alias("tp"))

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    return sums.withColumns({
        "precision": share(F.col("tp"), F.col("guessed")),
        "recall": share(F.col("tp"), F.col("support")),
        "f1": share(2 * F.col("tp"), F.col("guessed") + F.col("support")),
    })


def overall_scores(per_class: DataFrame, keys: list[str] = []) -> DataFrame:
    """Accuracy, weighted precision/recall/F1 and macro F1 over the union of labels."""
    n = F.sum("support")

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / n

    return per_class.groupBy(*keys).agg(
        (F.sum("tp") / n).alias("accuracy"), weighted("f1").alias("f1_weighted"), F.avg("f1").alias("f1_macro"),
        weighted("precision").alias("precision"), weighted("recall").alias("recall"), n.alias("n"))


def report(cells: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    """Per-class rows plus accuracy, macro and weighted rows."""
    per = class_scores(cells)
    classes = per.select(L.label_name(F.col("label"), names).alias("row"), "precision", "recall", "f1", "support")
    n = F.sum("support")

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / n

    acc = (F.sum("tp") / n).alias("f1")
    none = F.lit(None).cast("double")

    def total(name: str, p: Column, r: Column, f: Column) -> Column:
        return F.struct(F.lit(name).alias("row"), p.alias("precision"), r.alias("recall"), f.alias("f1"), F.col("n").alias("support"))

    totals = F.array(
        total("accuracy", none, none, F.col("a")), total("macro avg", F.col("mp"), F.col("mr"), F.col("mf")),
        total("weighted avg", F.col("wp"), F.col("wr"), F.col("wf")),
    )
    summed = per.agg(
        acc.alias("a"), n.alias("n"), F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        weighted("precision").alias("wp"), weighted("recall").alias("wr"), weighted("f1").alias("wf"))
    return classes.unionByName(summed.select(F.inline(totals)))


def auc(
    rows: DataFrame, score: str, positive: Column, keys: list[str] = [], *, target_bytes: int | None = None,
) -> DataFrame:
    """Exact area under the ROC curve per key, ties counted half; NULL when a class is missing.

    Rows collapse to distinct scores first; the running count over those is cut into score blocks
    when the table is large, so no task has to sort all scores.
    """
    keys = list(keys)
    tagged = rows.select(*keys, F.col(score).cast("double").alias("__s"), positive.alias("__p"))
    tagged, blocked = ordering.order_blocks(tagged, F.col("__s"), target_bytes)
    block = [ordering.BLOCK] if blocked else []
    group = [*keys, *block] or []
    one_key = [] if keys else ["__k"]
    by_score = tagged.groupBy(*group, "__s").agg(
        F.count_if("__p").alias("pos"), F.count_if(~F.col("__p")).alias("neg"))
    by_score = by_score.withColumn("__k", F.lit(0)) if one_key else by_score
    cum = ordering.running_before(by_score, keys or one_key, [F.col("__s")], "neg", "below", blocked=blocked)
    p, n = F.col("pos"), F.col("neg")
    summed = cum.groupBy(*(keys or one_key)).agg(
        F.sum(p * (F.col("below") + n / 2)).alias("u"), F.sum(p).alias("n_pos"), F.sum(n).alias("n_neg"))
    out = summed.withColumn("auc", F.try_divide(F.col("u"), (F.col("n_pos") * F.col("n_neg")).cast("double")))
    return out.drop("u", "__k")


def roc_auc(rows: DataFrame, scores: dict[int, str], actual: str = "actual", *, target_bytes: int | None = None) -> DataFrame:
    """One-vs-rest AUC of each class score and their mean weighted by prevalence; NULL as a whole if
    any class cannot be ranked. With two classes the score of the second one decides alone."""
    classes = sorted(scores)
    used = classes if len(classes) > 2 else classes[1:]
    per_class = F.array(*[
        F.struct(F.lit(c).alias("label"), F.col(scores[c]).cast("double").alias("score"), (F.col(actual) == c).alias("hit")) for c in used
    ])
    each = auc(rows.select(F.inline(per_class)), "score", F.col("hit"), ["label"], target_bytes=target_bytes)
    defined = F.count("auc") == F.count(F.lit(1))
    mean = F.sum(F.col("auc") * F.col("n_pos")) / F.sum("n_pos")
    return each.agg(F.when(defined, mean).alias("roc_auc"))


def fold_summary(folds: DataFrame, score: str = "accuracy") -> DataFrame:
    """Mean and population deviation over folds."""
    return folds.agg(F.avg(score).alias("cv_mean"), F.stddev_pop(score).alias("cv_std"), F.count(F.lit(1)).alias("folds"))


def loso_scores(out_of_fold: DataFrame, key: str = "subject_id") -> DataFrame:
    """Accuracy, weighted F1 and window count of every held-out subject."""
    scores = overall_scores(class_scores(confusion(out_of_fold, [key]), [key]), [key])
    return scores.select(key, "accuracy", "f1_weighted", F.col("n").alias("n_windows"))


def loso_summary(per_subject: DataFrame, min_subjects: int = 3) -> DataFrame:
    """Mean and population deviation over subjects; nothing below three subjects."""
    return per_subject.agg(
        F.count(F.lit(1)).alias("n_subjects"), F.sum("n_windows").alias("n_windows_total"),
        F.avg("accuracy").alias("loso_mean_accuracy"), F.stddev_pop("accuracy").alias("loso_std_accuracy"),
    ).where(F.col("n_subjects") >= min_subjects)


def metric_long(metrics: DataFrame, names: list[str], ids: list[str]) -> DataFrame:
    """(ids, metric, percent); a missing figure counts as 0."""
    filled = metrics.select(*ids, *[(F.coalesce(F.col(m).cast("double"), F.lit(0.0)) * 100).alias(m) for m in names])
    return filled.unpivot(ids, names, "metric", "percent")


def rank_models(metrics: DataFrame, keys: list[str], catalogue: str = "catalogue_idx") -> DataFrame:
    """Rank by accuracy, equal ones in catalogue order; the first without an error is the best.
    A key holds one row per classifier of the catalogue."""
    w = W.partitionBy(*keys).orderBy(F.col("accuracy").desc(), F.col(catalogue))
    ranked = metrics.withColumn("rank", F.row_number().over(w))
    return ranked.withColumn("is_best", (F.col("rank") == 1) & F.col("error").isNull())


def best_model(metrics: DataFrame, keys: list[str], name: str, catalogue: str = "catalogue_idx") -> DataFrame:
    return metrics.groupBy(*keys).agg(
        F.max_by(F.struct(name, "accuracy"), F.struct("accuracy", -F.col(catalogue))).alias("__b"),
    ).select(*keys, f"__b.{name}", "__b.accuracy")


def with_failures(metrics: DataFrame, error: Column, figures: list[str]) -> DataFrame:
    """Failed runs stay in the table: zero figures and the error text."""
    failed = error.isNotNull()
    cols = {f: F.when(failed, F.lit(0.0)).otherwise(F.col(f)) for f in figures}
    return metrics.withColumns({**cols, "error": error})
