"""Exact k nearest neighbours of a table of queries in a training table of any size: no row is sampled, no pair of tables is crossed.

Rows are ranked by their distance to one pivot, the training rows' mean. Two rows are at least as far apart as these distances differ, so a query needs only
the training rows whose distance to the pivot lies within its radius of its own. Training rows fall into blocks by that distance (at most ``MOST_BLOCKS``,
borders from quantiles), a block with more than ``BLOCK_ROWS`` rows, as equal distances make it, into parts by a hash.

First each query looks at one part near its own place: the k-th distance found there is its radius. Then it visits the parts of the blocks within that
radius, keeps its k nearest of each, and of these the k nearest overall, the smaller id first on a tie. Groups hold a part and a bounded share
of the queries that visit it. The driver holds a row per block.

Vectors have one width and no nulls; null ids are rows like others. With fewer than k training rows all of them are returned; an empty side gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorloom.operators.knn import Training, _matrix
from sensorloom.session import materialise, spread

BLOCK_ROWS = 20_000
MOST_BLOCKS = 4096
SLACK = 1e-9


def _shares(rows: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / size)).cast("int")


def _share_of(row_id: str, shares: list[int], block: str) -> Column:
    """Which share of its block a row falls in; ``shares`` has a number per block."""
    return F.pmod(F.xxhash64(F.lit(7), row_id), F.element_at(F.array(*[F.lit(s) for s in shares]), F.col(block) + 1)).cast("int")


def _number(borders: np.ndarray) -> Callable[[Column], Column]:
    @F.pandas_udf("int")
    def number(d: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(borders, d.to_numpy(), "right").astype("int32"))

    return number


def _known(rows: pd.DataFrame) -> Training:
    rows = rows.sort_values("tid", kind="stable")
    return Training(rows["tid"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["v"]))


def neighbours(
    train: DataFrame, queries: DataFrame, k: int = 5, *, train_id: str = "vec_id", query_id: str = "vec_id", vector: str = "features",
    label: str = "label", block_rows: int = BLOCK_ROWS, most_blocks: int = MOST_BLOCKS,
) -> DataFrame:
    """(qid, rank, tid, label, distance), as ``knn.neighbours`` without its bound on the training rows."""
    out = "qid long, rank int, tid long, label int, distance double"
    t = train.select(F.col(train_id).cast("long").alias("tid"), F.col(label).cast("int").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    n = t.count()
    if not n:
        return queries.sparkSession.createDataFrame([], out)
    pivot = t.select(vector_to_array(Summarizer.mean(array_to_vector("v")))).first()[0]
    centre = F.array(*[F.lit(v) for v in pivot])
    from_pivot = F.sqrt(F.aggregate(F.zip_with("v", centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    t = materialise(t.withColumn("d", from_pivot), "knn")
    blocks = min(most_blocks, -(-n // block_rows))
    borders = np.unique(t.approxQuantile("d", [i / blocks for i in range(1, blocks)], 0.25 / blocks)) if blocks > 1 else np.zeros(0)
    number = _number(borders)
    t = t.withColumn("block", number("d"))
    rows = {r.block: r for r in t.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).collect()}
    count = np.array([rows[b].n if b in rows else 0 for b in range(len(borders) + 1)])
    low = np.array([rows[b].low if b in rows else np.inf for b in range(len(count))])
    high = np.array([rows[b].high if b in rows else -np.inf for b in range(len(count))])
    parts = [max(1, -(-int(c) // block_rows)) for c in count]
    enough = np.flatnonzero(count >= min(k, n)) if (count >= min(k, n)).any() else np.array([int(count.argmax())])
    home = [int(enough[np.abs(enough - b).argmin()]) for b in range(len(count))]  # the nearest block with k rows
    t = t.withColumn("part", _share_of("tid", parts, "block"))

    # The radius of each query, from one part near it.
    q = queries.select(F.col(query_id).cast("long").alias("qid"), F.col(vector).cast("array<double>").alias("v")).withColumn("d", from_pivot)
    q = q.withColumn("block", F.element_at(F.array(*[F.lit(h) for h in home]), number("d") + 1))
    asked = {r.block: r.s for r in q.groupBy("block").agg(_shares(F.count(F.lit(1)), block_rows).alias("s")).collect()}
    shares = [asked.get(b, 1) for b in range(len(count))]
    mine = q.withColumn("share", _share_of("qid", shares, "block"))
    near = t.where("part = 0").withColumn("share", F.explode(F.sequence(F.lit(0), F.element_at(F.array(*[F.lit(s - 1) for s in shares]), F.col("block") + 1))))

    def radius(asking: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = asking[["qid", "v", "d"]].copy()
        known = _known(rows) if len(rows) >= k else None
        found["r"] = [float(d[-1]) for _, d in known.nearest(_matrix(found["v"]), k)] if known is not None and len(found) else np.inf
        return found

    keys = ["block", "share"]
    with_radius = spread(mine, keys).groupBy(*keys).cogroup(spread(near.select(*keys, "tid", "label", "v"), keys).groupBy(*keys)).applyInPandas(radius, "qid long, v array<double>, d double, r double")
    with_radius = materialise(with_radius, "knn")

    # The blocks within the radius: a stretch of the sorted blocks, as they don't overlap.
    full = np.flatnonzero(count > 0)
    first_of, last_of = low[full], high[full]

    @F.pandas_udf("a int, b int")  # two places, not a list: a query may visit as many blocks as there are
    def visits(d: pd.Series, r: pd.Series) -> pd.DataFrame:
        reach = r.to_numpy() + SLACK * (1 + d.to_numpy())
        a, b = np.searchsorted(last_of, d.to_numpy() - reach, "left"), np.searchsorted(first_of, d.to_numpy() + reach, "right")
        return pd.DataFrame({"a": a.astype("int32"), "b": b.astype("int32")})

    stretch = with_radius.withColumn("s", visits("d", "r")).where("s.a < s.b")
    block = F.element_at(F.array(*[F.lit(int(b)) for b in full]), F.col("at") + 1)
    visiting = stretch.select("qid", "v", F.explode(F.sequence("s.a", F.col("s.b") - 1)).alias("at")).select("qid", "v", block.alias("block"))
    asked = {r.block: r.s for r in visiting.groupBy("block").agg(_shares(F.count(F.lit(1)), block_rows).alias("s")).collect()}
    shares = [asked.get(b, 1) for b in range(len(count))]
    last_part = F.element_at(F.array(*[F.lit(p - 1) for p in parts]), F.col("block") + 1)
    mine = visiting.withColumns({"share": _share_of("qid", shares, "block"), "part": F.explode(F.sequence(F.lit(0), last_part))})
    theirs = t.select("block", "part", "tid", "label", "v").withColumn(
        "share", F.explode(F.sequence(F.lit(0), F.element_at(F.array(*[F.lit(s - 1) for s in shares]), F.col("block") + 1))))

    def search(asking: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(rows):
            return pd.DataFrame({"qid": [], "tid": [], "label": [], "distance": []})
        known = _known(rows)
        found = list(known.nearest(_matrix(asking["v"]), k))
        at, sizes = np.concatenate([f[0] for f in found]), [len(f[0]) for f in found]
        return pd.DataFrame({"qid": np.repeat(asking["qid"].to_numpy(), sizes), "tid": known.tid[at], "label": known.label[at], "distance": np.concatenate([f[1] for f in found])})

    keys = ["block", "part", "share"]
    partial = spread(mine, keys).groupBy(*keys).cogroup(spread(theirs, keys).groupBy(*keys)).applyInPandas(search, "qid long, tid long, label int, distance double")
    best = F.row_number().over(W.partitionBy("qid").orderBy("distance", "tid"))
    return partial.withColumn("rank", best).where(F.col("rank") <= k).select("qid", "rank", "tid", "label", "distance")
