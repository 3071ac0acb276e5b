"""k nearest neighbours against a bounded training matrix.

The training rows of a nearest-neighbour classifier are a bounded sample of labelled rows: at most
``MAX_TRAIN_ROWS``, those first in a hash order of their ids when there are more. They travel to the tasks as one matrix, and
queries of any number are scored where they are: no shuffle, no copies, in batch and on streams alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TRAIN_ROWS = 100_000
CELLS = 4_000_000  # distances computed at a time


@dataclass
class Training:
    """Training rows in id order."""

    tid: np.ndarray
    label: np.ndarray
    x: np.ndarray

    def nearest(self, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the places and distances of its k nearest rows, smaller id first on a tie."""
        k = min(k, len(self.tid))
        norms = (self.x**2).sum(axis=1)
        step = max(1, CELLS // max(1, len(self.tid)))
        for at in range(0, len(q), step):
            part = q[at : at + step]
            # One matrix product finds who may be near; those few get exact distances.
            square = (part**2).sum(axis=1)[:, None] + norms[None, :] - 2 * part @ self.x.T
            limit = np.partition(square, k - 1, axis=1)[:, k - 1] if k else np.zeros(len(part))
            slack = 1e-9 * ((part**2).sum(axis=1) + norms.max(initial=0.0)) + 1e-12
            for v, row, most in zip(part, square, limit + slack):
                near = np.flatnonzero(row <= most)
                distance = np.sqrt(((self.x[near] - v) ** 2).sum(axis=1))
                order = np.argsort(distance, kind="stable")[:k]
                yield near[order], distance[order]


def training(train: DataFrame, train_id: str = "vec_id", vector: str = "features", label: str = "label", most: int = MAX_TRAIN_ROWS) -> Training:
    """Fetch the training matrix; ``most`` rows at most."""
    t = train.select(F.col(train_id).cast("long").alias("tid"), F.col(label).cast("int").alias("label"), F.col(vector).alias("v"))
    rows = t.orderBy(F.xxhash64("tid"), "tid").limit(most).toPandas().sort_values("tid", kind="stable")
    return Training(rows["tid"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["v"]))


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def neighbours(
    train: DataFrame, queries: DataFrame, k: int = 5, *, train_id: str = "vec_id", query_id: str = "vec_id",
    vector: str = "features", label: str = "label", most: int = MAX_TRAIN_ROWS,
) -> DataFrame:
    """(qid, rank, tid, label, distance): the k nearest training rows, smaller id first on a tie."""
    sent = train.sparkSession.sparkContext.broadcast(_arrays(training(train, train_id, vector, label, most)))

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Training(*sent.value)
        for pdf in parts:
            if not len(pdf) or not len(known.tid):
                continue
            found = list(known.nearest(_matrix(pdf["v"]), k))
            at, d = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            sizes = [len(f[0]) for f in found]
            yield pd.DataFrame({
                "qid": np.repeat(pdf["qid"].to_numpy(), sizes), "rank": np.concatenate([np.arange(1, s + 1) for s in sizes]),
                "tid": known.tid[at], "label": known.label[at], "distance": d})

    q = queries.select(F.col(query_id).cast("long").alias("qid"), F.col(vector).alias("v"))
    return q.mapInPandas(search, "qid long, rank int, tid long, label int, distance double")


def _arrays(t: Training) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return t.tid, t.label, t.x  # plain arrays: executors need no copy of this package


def vote(found: DataFrame, labels: list[int]) -> DataFrame:
    """Distance-weighted vote: (qid, prediction, probability per label). An exact match silences
    all neighbours at a distance; on equal weight the smaller label wins."""
    exact = F.min("distance").over(W.partitionBy("qid")) == 0
    weight = F.when(exact, (F.col("distance") == 0).cast("double")).otherwise(1 / F.col("distance"))
    sums = [F.sum(F.when(F.col("label") == c, F.col("__w")).otherwise(0.0)).alias(f"__{c}") for c in labels]
    scored = found.withColumn("__w", weight).groupBy("qid").agg(*sums, F.sum("__w").alias("__t"))
    share = F.array(*[F.col(f"__{c}") / F.col("__t") for c in labels])
    scored = scored.select("qid", share.alias("probability"))
    top = F.array_position("probability", F.array_max("probability")).cast("int")
    return scored.select("qid", F.element_at(F.array(*[F.lit(c) for c in labels]), top).alias("prediction"), "probability")


def judge(train: DataFrame, vector: Column, k: int, labels: list[int], train_id: str = "vec_id", train_vector: str = "features", label: str = "label", most: int = MAX_TRAIN_ROWS) -> Column:
    """The same vote as a column: struct of ``prediction`` and ``probability`` of each row's vector, row by row, against ``most`` training rows at most."""
    sent = train.sparkSession.sparkContext.broadcast(_arrays(training(train, train_id, train_vector, label, most)))

    @F.pandas_udf(T.StructType([T.StructField("prediction", T.IntegerType()), T.StructField("probability", T.ArrayType(T.DoubleType()))]))
    def verdict(vectors: pd.Series) -> pd.DataFrame:
        known = Training(*sent.value)
        shares = np.zeros((len(vectors), len(labels)))
        for i, (at, d) in enumerate(known.nearest(_matrix(vectors), k) if len(vectors) else ()):
            weight = (d == 0).astype(float) if (d == 0).any() else 1 / d
            votes = np.array([weight[known.label[at] == c].sum() for c in labels])
            shares[i] = votes / weight.sum()
        return pd.DataFrame({"prediction": np.array(labels, dtype="int32")[shares.argmax(axis=1)], "probability": list(shares)})

    return verdict(vector)
