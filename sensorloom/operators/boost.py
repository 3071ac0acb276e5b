"""Softmax boosting of histogram trees, grown best leaf first, and many such models in one job.

In each round every class gets a tree on the gradients of the softmax loss. A leaf's histogram holds gradient and hessian sums
per (feature, bin); after a split the smaller child's is counted and the larger one's is the difference. The leaf with the largest gain is
split next, until ``leaves`` or ``depth`` is reached; without a cap on leaves the result is the level-wise tree.

Fitting takes all labelled rows, or with parameter ``most`` the first so many in a hash order of the row id. Spark writes the rows once, packed in
:func:`gathered`, and shuffles a copy to each model's task; they don't pass through the driver, but such a task holds the whole matrix (4 bytes a number). Each
model is a task: one for a single fit; one per fold or subject left out in ``fit_leaving_out``, whatever their number, in one job. Scoring is done where the rows lie; with models per fold, rows meet
their fold's model in groups of bounded size. Fitting is by seed and row order only, so a model doesn't depend on the job it was made in.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ROWS = 100_000  # of a sample that is asked for
MAX_CELLS = 8_000_000
CHUNK_BYTES = 4 << 20  # of rows packed in one cell
PIECE_ROWS = 50_000  # rows scored in one group where each fold has its own model
BINS = 64
LEAST_HESSIAN = 1e-6


# --- Growing -----------------------------------------------------------------------------------


def bin_edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Per feature, the borders between bins: between all distinct values if there are few, else at quantiles."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1), method="lower"))
            out.append(values[1:-1] if len(values) > 2 else values[1:])
        else:
            out.append(((values[1:].astype(np.float64) + values[:-1]) / 2).astype(np.float32))
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """A value belongs to the bin after all borders that it exceeds."""
    return np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1).astype(np.uint8)


def histogram(bins: np.ndarray, rows: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, size: int) -> np.ndarray:
    """(3, features, bins): gradient sum, hessian sum and rows."""
    width = bins.shape[1]
    cell = (bins[rows] + np.arange(width) * size).ravel()
    sums = [np.bincount(cell, np.repeat(v[rows], width), width * size) for v in (gradient, hessian)]
    return np.stack([*sums, np.bincount(cell, minlength=width * size)]).reshape(3, width, size)


def best_split(hist: np.ndarray, least: int) -> tuple[float, int, int]:
    """(gain, feature, last bin of the left side); gain 0 if there is none. Of equal gains the first feature and bin wins."""
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    total = hist.sum(axis=2)[:, :1, None]
    right = total - left
    fits = (left[2] >= least) & (right[2] >= least) & (left[1] > LEAST_HESSIAN) & (right[1] > LEAST_HESSIAN)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - total[0] ** 2 / total[1], 0.0)
    at = int(np.argmax(np.round(gain, 12)))
    return float(gain.flat[at]), *divmod(at, gain.shape[1])


def grow(bins: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, columns: np.ndarray, p: dict) -> tuple[list, list[np.ndarray]]:
    """A tree and the rows of its leaves. Nodes: [feature, bin, left, right, 0, gain], leaves: [-1, 0, 0, 0, value, 0]."""
    own, size = bins[:, columns], p["bins"]
    nodes, queue, count = [], [], 0

    def add(of: np.ndarray, hist: np.ndarray, depth: int) -> int:
        nodes.append([-1, 0, 0, 0, 0.0, 0.0])
        gain, feature, cut = best_split(hist, p["min_leaf"]) if depth < p["depth"] else (0.0, 0, 0)
        if gain > 1e-12:
            heapq.heappush(queue, (-gain, len(nodes) - 1, feature, cut, of, hist, depth))
        members[len(nodes) - 1] = of
        return len(nodes) - 1

    members: dict[int, np.ndarray] = {}
    add(rows, histogram(own, rows, gradient, hessian, size), 0)
    while queue and count + 1 < p["leaves"]:
        gain, at, feature, cut, of, hist, depth = heapq.heappop(queue)
        goes = own[of, feature] <= cut
        small, large = (of[goes], of[~goes]) if 2 * goes.sum() <= len(of) else (of[~goes], of[goes])
        counted = histogram(own, small, gradient, hessian, size)
        sides = (counted, hist - counted) if 2 * goes.sum() <= len(of) else (hist - counted, counted)
        del members[at], large
        left, right = add(of[goes], sides[0], depth + 1), add(of[~goes], sides[1], depth + 1)
        nodes[at], count = [int(columns[feature]), int(cut), left, right, 0.0, -gain], count + 1
    for at, of in members.items():
        nodes[at][4] = p["rate"] * p["shrink"] * gradient[of].sum() / max(hessian[of].sum(), LEAST_HESSIAN)
    return nodes, [(of, nodes[at][4]) for at, of in members.items()]


def train(x: np.ndarray, y: np.ndarray, classes: int, params: dict) -> dict:
    """A model from a matrix and class numbers. ``params``: rounds, depth, rate; leaves, min_leaf, rows, columns, bins, seed."""
    p = {"leaves": 1 << 30, "min_leaf": 1, "rows": 1.0, "columns": 1.0, "bins": BINS, "seed": 42, **params, "shrink": (classes - 1) / classes}
    edges = bin_edges(x, p["bins"])
    bins, (n, width) = binned(x, edges), x.shape
    rng = np.random.default_rng(p["seed"])
    share = np.maximum(np.bincount(y, minlength=classes) / max(n, 1), 1e-9)
    start = np.log(share)
    scores, aim, trees, gains = np.tile(start, (n, 1)), np.eye(classes)[y], [], np.zeros(width)
    for _ in range(p["rounds"]):
        chance = softmax(scores)
        rows = np.sort(rng.permutation(n)[: max(1, int(p["rows"] * n))]) if p["rows"] < 1 else np.arange(n)
        rest = np.setdiff1d(np.arange(n), rows, assume_unique=True)
        for k in range(classes):
            columns = np.sort(rng.permutation(width)[: max(1, int(p["columns"] * width))]) if p["columns"] < 1 else np.arange(width)
            nodes, leaves = grow(bins, aim[:, k] - chance[:, k], chance[:, k] * (1 - chance[:, k]), rows, columns, p)
            for of, value in leaves:
                scores[of, k] += value
            # The border of the bin stands for the value, so that new rows need no bins.
            tree = [[f, float(edges[f][b]), left, right, v] if f >= 0 else [-1, 0.0, 0, 0, v] for f, b, left, right, v, _ in nodes]
            for f, *_, gain in nodes:
                if f >= 0:
                    gains[f] += gain
            if len(rest):
                scores[rest, k] += walk(tree, x[rest])
            trees.append(tree)
    return {"start": start.tolist(), "classes": classes, "trees": trees, "gains": (gains / max(gains.sum(), 1e-300)).tolist()}


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def walk(tree: list, x: np.ndarray) -> np.ndarray:
    """The value of the leaf that each row reaches."""
    feature, border, left, right, value = (np.array(c) for c in zip(*tree))
    at = np.zeros(len(x), np.int64)
    moving = np.arange(len(x)) if feature[0] >= 0 else np.zeros(0, np.int64)
    while len(moving):
        node = at[moving]
        at[moving] = np.where(x[moving, feature[node]] <= border[node].astype(np.float32), left[node], right[node])
        moving = moving[feature[at[moving]] >= 0]
    return value[at]


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    scores = np.tile(model["start"], (len(x), 1))
    for i, tree in enumerate(model["trees"]):
        scores[:, i % model["classes"]] += walk(tree, x)
    return softmax(scores)


# --- On tables ---------------------------------------------------------------------------------


def _own(rows: DataFrame, row_id: str, features: Column, number: Column, fold: Column | None) -> DataFrame:
    return rows.select(F.xxhash64(row_id).alias("h"), F.col(row_id).cast("string").alias("id"), features.cast("array<float>").alias("x"), number.cast("int").alias("y"),
                       (F.lit(None) if fold is None else fold).cast("string").alias("fold"))


def _arrays(found: pa.Table):
    """(matrix, class numbers, folds as text) in the hash order."""
    found = found.sort_by([("h", "ascending"), ("id", "ascending")])
    x = found.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(found.num_rows, -1)
    return x, found.column("y").to_numpy().astype(np.int64), np.array(found.column("fold").to_pylist(), dtype=object)


def sample(rows: DataFrame, row_id: str, features: Column, number: Column, width: int, fold: Column | None = None, most: int = MAX_ROWS):
    """(matrix, class numbers, folds as text) of the first rows in a hash order, as many as the bounds allow, on the driver. The learners don't take it."""
    most = max(1, min(most, MAX_CELLS // max(1, width)))
    return _arrays(_own(rows, row_id, features, number, fold).orderBy("h", "id").limit(most).toArrow())


def gathered(rows: DataFrame, row_id: str, features: Column, number: Column, fold: Column | None = None, most: int | None = None) -> DataFrame:
    """``chunk``: all rows, or the first ``most`` in a hash order, as Arrow batches of ``CHUNK_BYTES`` in binary cells, written once."""
    from sensorloom.session import materialise

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, CHUNK_BYTES * max(1, batch.num_rows) // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(at, step))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk"])

    own = _own(rows, row_id, features, number, fold)
    return materialise((own if most is None else own.orderBy("h", "id").limit(most)).mapInArrow(pack, "chunk binary"), "rows")


def opened(held: pa.Table):
    """(matrix, class numbers, folds as text) of all rows of the chunks, in the hash order."""
    parts = [pa.ipc.open_stream(c.as_buffer()).read_all() for c in held.column("chunk") if c.is_valid]
    if not parts:
        raise ValueError("no labelled rows")
    return _arrays(pa.concat_tables(parts))


def beside(asked: DataFrame, keys: list[str], chunks: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work(asked rows, chunks)`` for each group of ``keys`` in ``asked``, a group that gets a copy of all chunks."""
    own = [f"of_{k}" for k in keys]
    groups = asked.select(*[F.col(k).alias(o) for k, o in zip(keys, own)]).distinct()
    parts = max(1, min(4 * groups.count(), 8 * chunks.sparkSession.sparkContext.defaultParallelism))  # so that few of the cores wait for others
    copies = chunks.crossJoin(F.broadcast(groups))
    return asked.repartition(parts, *keys).groupBy(*keys).cogroup(copies.repartition(parts, *own).groupBy(*own)).applyInArrow(work, schema)


def _fit_tasks(chunks: DataFrame, names: list[str | None], classes: int, params: dict) -> DataFrame:
    """``fold``, ``model`` (JSON): for each name a model of the rows outside that fold; of all rows for null."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        name, (x, y, folds) = asked.column("fold")[0].as_py(), opened(held)
        inside = np.ones(len(y), bool) if name is None else folds != name
        return pa.table({"fold": pa.array([name], pa.string()), "model": pa.array([json.dumps(train(x[inside], y[inside], classes, params))], pa.string())})

    asked = chunks.sparkSession.createDataFrame([(n,) for n in names], "fold string")
    return beside(asked, ["fold"], chunks, run, "fold string, model string")


def fit(rows: DataFrame, row_id: str, features: Column, number: Column, classes: int, width: int, params: dict) -> dict:
    """One model, as ``train`` makes it, fitted in one task. Its size depends on the parameters, not on the rows."""
    chunks = gathered(rows, row_id, features, number, most=params.get("most"))
    return json.loads(_fit_tasks(chunks, [None], classes, params).first()["model"])


def scorer(model: dict):
    """A column of class probabilities from a column of features."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(np.float32) if len(v) else np.zeros((0, 1), np.float32)
        return pd.Series(list(probabilities(model, x)), dtype=object)

    return score


def fit_leaving_out(rows: DataFrame, fold: str, row_id: str, features: Column, number: Column, classes: int, width: int, params: dict) -> DataFrame:
    """``fold``, ``row_id`` and ``probability`` of every row, from the model that was fitted without the row's fold: one job fits
    all models, one scores all rows."""
    chunks = gathered(rows, row_id, features, number, F.col(fold), params.get("most"))
    names = [r[0] for r in rows.select(F.col(fold).cast("string")).distinct().collect()]
    from sensorloom.session import materialise

    models = materialise(_fit_tasks(chunks, names, classes, params), "models")
    pieces = -(-rows.count() // PIECE_ROWS)
    dealt = models.select(F.col("fold").alias("of"), "model", F.explode(F.sequence(F.lit(0), F.lit(max(0, pieces - 1)))).alias("of_piece"))
    kind = rows.schema[row_id].dataType.simpleString()
    own = rows.select(F.col(fold).cast("string").alias("fold"), F.pmod(F.xxhash64(row_id), F.lit(max(1, pieces))).cast("int").alias("piece"), F.col(row_id).alias("row_id"), features.cast("array<float>").alias("x"))

    def run(mine: pa.Table, made: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return pa.table({"fold": pa.array([], pa.string()), "row_id": mine.column("row_id"), "probability": pa.array([], pa.list_(pa.float64()))})
        x = mine.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(mine.num_rows, -1)
        found = probabilities(json.loads(made.column("model")[0].as_py()), x)
        return pa.table({"fold": mine.column("fold"), "row_id": mine.column("row_id"), "probability": pa.array(list(found), pa.list_(pa.float64()))})

    scored = own.groupBy("fold", "piece").cogroup(dealt.groupBy("of", "of_piece")).applyInArrow(run, f"fold string, row_id {kind}, probability array<double>")
    return scored.withColumnRenamed("row_id", row_id)
