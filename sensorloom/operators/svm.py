"""Kernel support vector machines (RBF) by a cascade of exact solvers, with pairwise probabilities, many models in one set of jobs.

Every pair of classes has a machine. Its rows lie in pieces; a pass solves each piece together with the machine's present support
vectors, then merges the solutions pair by pair and solves again, warm, until one is left (Graf et al., 2005). Rows that break the optimum's
conditions enter the next pass; a machine is done when no row of any piece does, so it is the optimum of all rows, not of a piece.
The solver is sequential minimal optimisation with second-order choice of the pair where the kernel fits into ``CACHE_BYTES``. Beyond that the same steps are
made within blocks of the ``WORKING`` rows that break the conditions most, a matrix product each, half of them kept for the next block, up to the same conditions over all rows.
A machine is one piece by default: where most rows are support vectors, a cascade solves nearly the whole machine once per piece.

Probabilities: ``INNER`` further machines per pair each leave a part of the rows out; a sigmoid is fitted on the values of the left-out rows (Platt),
and the pairs' probabilities are coupled (Wu, Lin and Weng, 2004, second method). The predicted class has the most votes, the first of several.

Fitting takes all labelled rows, or with parameter ``most`` the first so many in a hash order of the row id. :func:`boost.gathered` writes them once and each
machine's task gets a copy; they don't pass through the driver. The work of a machine grows with the square of its rows. What a pass writes holds ids and weights only. The machines of all folds or subjects left out
share the same jobs; their number changes the rows of a job, not the number of jobs. A model stays in the shared folder: a row per fold, beside the rows that
its ids point to. Only :func:`fit` and :func:`scorer`, for streams, bring it to the driver.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.operators import boost
from sensorloom.session import materialise, spread

MAX_ROWS = 20_000  # of a sample that is asked for
PIECE = 1 << 31  # rows solved at a time in a cascade's first layer
SCORED_ROWS = 5_000  # in one group beside a model's support vectors
ROWS = 500  # rows whose values are computed at a time
CACHE_BYTES = 128 << 20
WORKING = 400
WORKING_BYTES = 512 << 20  # of their kernel
GAP = 1e-3
INNER = 5
KEYS = ["fold", "inner", "a", "b"]
STATE = "fold string, inner int, a int, b int, piece int, ids array<int>, alphas array<double>, bias double, objective double, broken long"
PAIR = T.ArrayType(T.DoubleType())


# --- The solver --------------------------------------------------------------------------------


def kernel(x: np.ndarray, z: np.ndarray, gamma: float) -> np.ndarray:
    out = (x * x).sum(axis=1)[:, None] + (z * z).sum(axis=1)
    product = x @ z.T
    product *= 2
    out -= product
    np.maximum(out, 0, out=out)
    out *= -gamma
    return np.exp(out, out=out)


def solve(x: np.ndarray, sign: np.ndarray, cap: np.ndarray, gamma: float, alpha: np.ndarray | None = None, gap: float = GAP) -> tuple[np.ndarray, float, float]:
    """(weights, bias, dual objective): the largest sum of weights less half the squared norm, each weight within 0 and its ``cap``,
    signs balanced. A start ``alpha`` has to be feasible."""
    n = len(sign)
    alpha = np.zeros(n) if alpha is None else alpha.copy()
    if 8 * n * n > CACHE_BYTES:
        return _solve_blocks(x, sign, cap, gamma, alpha, gap)
    kept: OrderedDict[int, np.ndarray] = OrderedDict()
    room = max(2, CACHE_BYTES // (8 * max(1, n)))

    def row(i: int) -> np.ndarray:
        if i in kept:
            kept.move_to_end(i)
            return kept[i]
        if len(kept) >= room:
            kept.popitem(last=False)
        kept[i] = kernel(x[i : i + 1], x, gamma)[0]
        return kept[i]

    slope = sign.astype(np.float64)  # sign less the machine's value without bias
    for i in np.flatnonzero(alpha):
        slope -= alpha[i] * sign[i] * row(i)
    rises, falls = np.zeros(n), np.zeros(n)  # 0 where sign * weight may rise or fall, else infinite

    def bound(i) -> None:
        full, empty = alpha[i] >= cap[i], alpha[i] <= 0
        rises[i] = np.where(np.where(sign[i] > 0, full, empty), -np.inf, 0.0)
        falls[i] = np.where(np.where(sign[i] > 0, empty, full), np.inf, 0.0)

    bound(np.arange(n))
    while True:
        up = slope + rises
        i = int(np.argmax(up)) if n else 0
        high, low = (up[i], float((slope + falls).min())) if n else (0.0, 0.0)
        if not high - low >= gap:
            break
        ki = row(i)
        drop = high - (slope + falls)
        curve = np.maximum(2 - 2 * ki, 1e-12)
        j = int(np.argmax(np.where(drop > 0, drop * drop / curve, -np.inf)))
        step = min(drop[j] / curve[j], cap[i] - alpha[i] if sign[i] > 0 else alpha[i], alpha[j] if sign[j] > 0 else cap[j] - alpha[j])
        for at, way in ((i, 1), (j, -1)):
            moved = alpha[at] + way * sign[at] * step
            alpha[at] = 0.0 if moved < 1e-12 * cap[at] else cap[at] if moved > (1 - 1e-12) * cap[at] else moved
        slope -= step * (ki - row(j))
        bound(np.array([i, j]))
    return _solved(alpha, sign, cap, slope, high, low)


def _solved(alpha: np.ndarray, sign: np.ndarray, cap: np.ndarray, slope: np.ndarray, high: float, low: float) -> tuple[np.ndarray, float, float]:
    free = (alpha > 0) & (alpha < cap)
    ends = [v for v in (high, low) if np.isfinite(v)]
    bias = float(slope[free].mean()) if free.any() else float(np.mean(ends)) if ends else 0.0
    return alpha, bias, float(alpha.sum() - 0.5 * (alpha * (1 - sign * slope)).sum())


def _bounds(alpha: np.ndarray, sign: np.ndarray, cap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0 where sign * weight may rise or fall, else infinite."""
    full, empty = alpha >= cap, alpha <= 0
    return np.where(np.where(sign > 0, full, empty), -np.inf, 0.0), np.where(np.where(sign > 0, empty, full), np.inf, 0.0)


def _solve_blocks(x: np.ndarray, sign: np.ndarray, cap: np.ndarray, gamma: float, alpha: np.ndarray, gap: float) -> tuple[np.ndarray, float, float]:
    """``solve`` in blocks of rows. The pair that breaks the conditions most is always in the block, so every block raises the objective."""
    n, slope = len(sign), sign.astype(np.float64)
    size = max(2, min(WORKING, n, WORKING_BYTES // (8 * n)) // 2 * 2)
    set_out = np.flatnonzero(alpha)
    for s in range(0, len(set_out), size):
        w = set_out[s : s + size]
        slope -= (alpha[w] * sign[w]) @ kernel(x[w], x, gamma)
    block, rows = np.zeros(0, np.int64), np.zeros((0, n))
    while True:
        rises, falls = _bounds(alpha, sign, cap)
        up, down = slope + rises, slope + falls
        high, low = float(up.max()), float(down.min())
        if not high - low >= gap:
            return _solved(alpha, sign, cap, slope, high, low)
        block, rows = block[len(block) // 2 :], rows[len(block) // 2 :]
        most = (size - len(block)) // 2
        up[block] = -np.inf
        first = np.argpartition(-up, most)[:most]
        first = first[up[first] > -np.inf]
        down[block] = down[first] = np.inf
        second = np.argpartition(down, most)[:most]
        new = np.concatenate([first, second[down[second] < np.inf]])
        block, rows = np.concatenate([block, new]), np.concatenate([rows, kernel(x[new], x, gamma)])
        own = _within(rows[:, block], sign[block], cap[block], alpha[block], slope[block], max(gap / 2, (high - low) / 10))
        moved = own != alpha[block]
        slope -= (sign[block] * (own - alpha[block]))[moved] @ rows[moved]
        alpha[block] = own


def _within(k: np.ndarray, sign: np.ndarray, cap: np.ndarray, alpha: np.ndarray, slope: np.ndarray, gap: float) -> np.ndarray:
    """The weights of a block, whose kernel is ``k``, after steps of pairs within it; at most 20 steps per row."""
    rises, falls = _bounds(alpha, sign, cap)
    for _ in range(20 * len(sign)):
        up = slope + rises
        i = int(np.argmax(up))
        drop = up[i] - (slope + falls)
        if not drop.max() >= gap:
            break
        curve = np.maximum(2 - 2 * k[i], 1e-12)
        j = int(np.argmax(np.where(drop > 0, drop * drop / curve, -np.inf)))
        step = min(drop[j] / curve[j], cap[i] - alpha[i] if sign[i] > 0 else alpha[i], alpha[j] if sign[j] > 0 else cap[j] - alpha[j])
        for at, way in ((i, 1), (j, -1)):
            moved = alpha[at] + way * sign[at] * step
            alpha[at] = 0.0 if moved < 1e-12 * cap[at] else cap[at] if moved > (1 - 1e-12) * cap[at] else moved
        slope -= step * (k[i] - k[j])
        both = [i, j]
        rises[both], falls[both] = _bounds(alpha[both], sign[both], cap[both])
    return alpha


def sigmoid(value: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of P(positive) = 1 / (1 + exp(slope * value + offset)) by Newton's method with smoothed targets."""
    ups, downs = int(positive.sum()), int((~positive).sum())
    aim = np.where(positive, (ups + 1) / (ups + 2), 1 / (downs + 2))
    slope, offset = 0.0, float(np.log((downs + 1) / (ups + 1)))

    def loss(s: float, o: float) -> float:
        z = s * value + o
        return float((np.logaddexp(0, z) - (1 - aim) * z).sum())

    now = loss(slope, offset)
    for _ in range(100):
        p = 1 / (1 + np.exp(np.clip(slope * value + offset, -700, 700)))
        error, weight = aim - p, p * (1 - p)
        g = np.array([(value * error).sum(), error.sum()])
        if np.abs(g).max(initial=0) < 1e-5:
            break
        h = np.array([[(value * value * weight).sum() + 1e-12, (value * weight).sum()], [(value * weight).sum(), weight.sum() + 1e-12]])
        way, size = -np.linalg.solve(h, g), 1.0
        while size >= 1e-10 and (then := loss(slope + size * way[0], offset + size * way[1])) >= now + 1e-4 * size * float(g @ way):
            size /= 2
        if size < 1e-10:
            break
        slope, offset, now = slope + size * way[0], offset + size * way[1], then
    return slope, offset


def couple(pairs: np.ndarray) -> np.ndarray:
    """Class probabilities from ``pairs[n, i, j]`` = P(i | i or j): the least squares of p_i r_ji - p_j r_ij with sum 1."""
    n, k, _ = pairs.shape
    if k == 1:
        return np.ones((n, 1))
    off = ~np.eye(k, dtype=bool)
    left = np.zeros((n, k + 1, k + 1))
    left[:, :k, :k] = np.where(off, -pairs * pairs.transpose(0, 2, 1), 0)
    left[:, np.arange(k), np.arange(k)] = (np.where(off, pairs, 0) ** 2).sum(axis=1)
    left[:, k, :k] = left[:, :k, k] = 1
    right = np.zeros((n, k + 1, 1))
    right[:, k] = 1
    p = np.maximum(np.linalg.solve(left, right)[:, :k, 0], 0)
    return p / p.sum(axis=1, keepdims=True)


# --- Passes ------------------------------------------------------------------------------------


class Sample:
    """The rows that models are fitted on, and how each fold sees them: standardised, with its own caps and kernel width."""

    def __init__(self, x, y, folds, classes: int, C: float, balanced: bool):
        self.x, self.y, self.folds, self.classes, self.C, self.balanced = x, y, folds, classes, C, balanced
        self.seen = (object(), None)

    def view(self, fold: str | None):
        """(part each training row is dealt to, -2 outside, mean, scale, gamma, cap per class), remembered for the last fold."""
        if self.seen[0] != fold or self.seen[1] is None:
            inside = np.ones(len(self.y), bool) if fold is None else self.folds != fold
            own = self.x[inside].astype(np.float64)
            mean, scale = (own.mean(axis=0), own.std(axis=0)) if len(own) else (np.zeros(self.x.shape[1]), np.ones(self.x.shape[1]))
            scale = np.where(scale > 0, scale, 1.0)
            spread_of = float(((own - mean) / scale).var()) if own.size else 0.0
            counts = np.bincount(self.y[inside], minlength=self.classes)
            weight = inside.sum() / (max(1, (counts > 0).sum()) * np.maximum(counts, 1)) if self.balanced else np.ones(self.classes)
            ids = np.flatnonzero(inside)
            ids = ids[np.argsort(self.y[ids], kind="stable")]
            part = np.full(len(self.y), -2)
            part[ids] = (np.arange(len(ids)) - np.searchsorted(self.y[ids], self.y[ids])) % INNER  # class by class
            self.seen = (fold, (part, mean, scale, 1.0 / (self.x.shape[1] * spread_of) if spread_of > 0 else 1.0, self.C * weight))
        return self.seen[1]

    def rows(self, fold: str | None, ids: np.ndarray) -> np.ndarray:
        _, mean, scale, _, _ = self.view(fold)
        return (self.x[ids].astype(np.float64) - mean) / scale

    def trained_on(self, fold: str | None, inner: int, a: int, b: int) -> np.ndarray:
        part = self.view(fold)[0]
        return np.flatnonzero((part > -2) & ((self.y == a) | (self.y == b)) & (part != inner))

    def left_out(self, fold: str | None, inner: int, a: int, b: int) -> np.ndarray:
        return np.flatnonzero((self.view(fold)[0] == inner) & ((self.y == a) | (self.y == b)))

    def values(self, fold: str | None, ids: np.ndarray, of: np.ndarray, a: int, alphas: np.ndarray, bias: float) -> np.ndarray:
        """The machine's values at the rows ``ids``, a block at a time; positive means class ``a``."""
        gamma, weights = self.view(fold)[3], alphas * np.where(self.y[of] == a, 1, -1)
        vectors = self.rows(fold, of)
        blocks = [kernel(self.rows(fold, ids[s : s + ROWS]), vectors, gamma) @ weights + bias for s in range(0, len(ids), ROWS)]
        return np.concatenate(blocks) if blocks else np.zeros(0)

    def solve(self, fold: str | None, a: int, ids: np.ndarray, of: np.ndarray, alphas: np.ndarray):
        """Solve on the rows ``ids`` from the weights of ``of``, a part of them: (support vectors, weights, bias, objective)."""
        _, _, _, gamma, caps = self.view(fold)
        start = np.zeros(len(ids))
        start[np.searchsorted(ids, of)] = alphas
        found, bias, objective = solve(self.rows(fold, ids), np.where(self.y[ids] == a, 1, -1), caps[self.y[ids]], gamma, start)
        return ids[found > 0], found[found > 0], bias, objective


def _arrays(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.array(row["ids"], np.int64), np.array(row["alphas"], np.float64)


def _out(rows: list[dict]) -> pa.Table:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.int64()]
    names = [*KEYS, "piece", "ids", "alphas", "bias", "objective", "broken"]
    return pa.table([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds)], names=names)


@dataclass
class Stored:
    """The rows that models are fitted on, in the chunks of :func:`boost.gathered`."""

    chunks: DataFrame
    size: int
    classes: int
    C: float
    balanced: bool


def _each(asked: DataFrame, keys: list[str], held, work: Callable[[list[dict], Sample], pa.Table], schema: str) -> DataFrame:
    """``work(asked rows, sample)`` for each group of ``keys``. ``held``: a :class:`Stored`, or a broadcast of a sample's parts."""
    if not isinstance(held, Stored):
        return spread(asked, keys).groupBy(*keys).applyInArrow(lambda t: work(t.to_pylist(), Sample(*held.value)), schema)
    more = (held.classes, held.C, held.balanced)
    return boost.beside(asked, keys, held.chunks, lambda t, chunks: work(t.to_pylist(), Sample(*boost.opened(chunks), *more)), schema)


def _cascade(state: DataFrame, held, pieces: int) -> DataFrame:
    """One pass for the machines in ``state``; ``broken`` counts the rows that broke a condition before it."""

    def refine(rows: list[dict], s: Sample) -> pa.Table:
        r = rows[0]
        of, alphas = _arrays(r)
        own = s.trained_on(r["fold"], r["inner"], r["a"], r["b"])
        own = np.setdiff1d(own[own % pieces == r["piece"]], of, assume_unique=True)
        value = s.values(r["fold"], own, of, r["a"], alphas, r["bias"])
        breaks = own[value * np.where(s.y[own] == r["a"], 1, -1) < 1 - 2 * GAP]
        r["broken"] = len(breaks)
        if len(breaks):
            of, alphas, r["bias"], r["objective"] = s.solve(r["fold"], r["a"], np.union1d(of, breaks), of, alphas)
        return _out([{**r, "ids": of.tolist(), "alphas": alphas.tolist()}])

    def merge(rows: list[dict], s: Sample) -> pa.Table:
        rows = sorted(rows, key=lambda r: r["piece"])
        best = max(rows, key=lambda r: r["objective"])
        of, alphas = _arrays(best)
        ids = np.unique(np.concatenate([_arrays(r)[0] for r in rows]))
        bias, objective = best["bias"], best["objective"]
        if len(rows) > 1 and any(r["broken"] for r in rows):
            of, alphas, bias, objective = s.solve(best["fold"], best["a"], ids, of, alphas)
        told = {"piece": rows[0]["piece"] // 2, "ids": of.tolist(), "alphas": alphas.tolist(), "bias": bias, "objective": objective}
        return _out([{**best, **told, "broken": sum(r["broken"] for r in rows)}])

    each = state.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    layer = materialise(_each(each, [*KEYS, "piece"], held, refine, STATE), "svm")
    while pieces > 1:
        layer = layer.withColumn("half", F.floor(F.col("piece") / 2).cast("int"))
        layer = materialise(_each(layer, [*KEYS, "half"], held, merge, STATE), "svm")
        pieces = (pieces + 1) // 2
    return layer


def machines(spark: SparkSession, held, folds: list[str | None], inner: int = INNER, pieces: int | None = None) -> DataFrame:
    """(``STATE``) the optimum of every pair of classes of every fold, on all rows (inner -1) and without each of ``inner`` parts."""
    classes, size = (held.classes, held.size) if isinstance(held, Stored) else (held.value[3], len(held.value[1]))
    pairs = [(a, b) for a in range(classes) for b in range(a + 1, classes)]
    pieces = pieces or max(1, -(-size // PIECE))
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    keys = spark.createDataFrame([(f,) for f in folds], "fold string").select("fold", F.explode(F.sequence(F.lit(-1), F.lit(inner - 1))).alias("inner"), F.inline(each))
    empty = [F.lit(0).alias("piece"), F.array().cast("array<int>").alias("ids"), F.array().cast("array<double>").alias("alphas"),
             F.lit(0.0).alias("bias"), F.lit(0.0).alias("objective"), F.lit(0).cast("long").alias("broken")]
    state, done = keys.select(*KEYS, *empty), []
    while True:
        after = _cascade(state, held, pieces)
        done.append(after.where("broken = 0"))
        state = after.where("broken > 0")
        if state.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def models(spark: SparkSession, held: Stored, folds: list[str | None], params: dict) -> DataFrame:
    """``fold`` and ``model``: a model is the list of its machines with their sigmoids, as JSON."""
    if held.classes < 2:
        return spark.createDataFrame([(f, "[]") for f in folds], "fold string, model string")
    found = materialise(machines(spark, held, folds, pieces=params.get("pieces")), "svm")

    def left_out(rows: list[dict], s: Sample) -> pa.Table:
        r = rows[0]
        of, alphas = _arrays(r)
        rest = s.left_out(r["fold"], r["inner"], r["a"], r["b"])
        value = s.values(r["fold"], rest, of, r["a"], alphas, r["bias"])
        return pa.table({
            "fold": pa.array([r["fold"]], pa.string()), "a": pa.array([r["a"]], pa.int32()), "b": pa.array([r["b"]], pa.int32()), "inner": pa.array([r["inner"]], pa.int32()),
            "value": pa.array([value.tolist()], pa.list_(pa.float64())), "positive": pa.array([(s.y[rest] == r["a"]).tolist()], pa.list_(pa.bool_()))})

    def curve(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["inner"])
        slope, offset = sigmoid(np.concatenate([r["value"] for r in rows]), np.concatenate([np.array(r["positive"], bool) for r in rows]))
        first = table.slice(0, 1).select(["fold", "a", "b"])
        return first.append_column("slope", pa.array([slope], pa.float64())).append_column("offset", pa.array([offset], pa.float64()))

    values = _each(found.where("inner >= 0"), KEYS, held, left_out, "fold string, a int, b int, inner int, value array<double>, positive array<boolean>")
    curves = values.groupBy("fold", "a", "b").applyInArrow(curve, "fold string, a int, b int, slope double, offset double")
    full, c = found.where("inner = -1").alias("m"), curves.alias("c")
    both = full.join(c, F.col("m.fold").eqNullSafe(F.col("c.fold")) & (F.col("m.a") == F.col("c.a")) & (F.col("m.b") == F.col("c.b")))
    one = F.struct("m.a", "m.b", "m.ids", "m.alphas", "m.bias", "c.slope", "c.offset")
    return both.groupBy(F.col("m.fold").alias("fold")).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("model"))  # pairs of classes per fold


# --- On tables ---------------------------------------------------------------------------------


def judge(found: list[dict], x: np.ndarray, vectors: np.ndarray, position: np.ndarray, y: np.ndarray, gamma: float, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities, votes) of standardised rows. ``position`` finds a support vector's row in ``vectors``."""
    votes, pairs = np.zeros((len(x), classes)), np.full((len(x), classes, classes), 0.5)
    for s in range(0, len(x), ROWS):
        k = kernel(x[s : s + ROWS], vectors, gamma)
        for m in found:
            at = position[m["ids"]]
            value = k[:, at] @ (np.array(m["alphas"]) * np.where(y[at] == m["a"], 1, -1)) + m["bias"]
            p = np.clip(1 / (1 + np.exp(np.clip(m["slope"] * value + m["offset"], -700, 700))), 1e-7, 1 - 1e-7)
            pairs[s : s + ROWS, m["a"], m["b"]], pairs[s : s + ROWS, m["b"], m["a"]] = p, 1 - p
            votes[s : s + ROWS, m["a"]] += value > 0
            votes[s : s + ROWS, m["b"]] += value <= 0
    return couple(pairs), votes


def _stored(rows: DataFrame, row_id: str, features: Column, number: Column, classes: int, params: dict, fold: Column | None = None) -> Stored:
    chunks = boost.gathered(rows, row_id, features, number, fold, params.get("most"))
    return Stored(chunks, rows.count(), classes, params["C"], bool(params.get("balanced")))


def fit_table(rows: DataFrame, row_id: str, features: Column, number: Column, classes: int, width: int, params: dict) -> dict:
    """One model in the shared folder: its machines are a table as :func:`models` gives it, their ids point to the rows of the chunks."""
    spark = rows.sparkSession
    held = _stored(rows, row_id, features, number, classes, params)
    made = materialise(models(spark, held, [None], params), "model")

    def view(_: list[dict], s: Sample) -> pa.Table:
        _, mean, scale, gamma, _ = s.view(None)
        return pa.table({"mean": pa.array([mean.tolist()], pa.list_(pa.float64())), "scale": pa.array([scale.tolist()], pa.list_(pa.float64())), "gamma": [gamma]})

    seen = _each(spark.createDataFrame([(0,)], "task int"), ["task"], held, view, "mean array<double>, scale array<double>, gamma double").first()
    return {"classes": classes, "gamma": seen.gamma, "mean": seen["mean"], "scale": seen.scale, "machines": made, "y": held.chunks, "vectors": held.chunks}


def fit(rows: DataFrame, row_id: str, features: Column, number: Column, classes: int, width: int, params: dict) -> dict:
    """One model on the driver: machines, the support vectors and how to standardise."""
    return fetched(fit_table(rows, row_id, features, number, classes, width, params))


def fetched(model: dict) -> dict:
    """A model of :func:`fit_table` as lists on the driver."""
    x, y, _ = boost.opened(model["vectors"].toArrow())
    found = json.loads(model["machines"].first()["model"])
    used = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.array(m["ids"], np.int64) for m in found)]))
    for m in found:
        m["ids"] = np.searchsorted(used, m["ids"]).tolist()
    return {**model, "machines": found, "y": y[used].tolist(), "vectors": x[used].tolist()}


def scorer(spark: SparkSession, model: dict):
    """A column of structs (``probability``, ``votes``) from a column of features, for streams."""
    mean, scale = np.array(model["mean"]), np.array(model["scale"])
    vectors = (np.array(model["vectors"], np.float64).reshape(-1, len(mean)) - mean) / scale
    sent = spark.sparkContext.broadcast((vectors, np.array(model["y"], np.int64), model["machines"]))
    gamma, classes = model["gamma"], model["classes"]

    @F.pandas_udf(T.StructType([T.StructField("probability", PAIR), T.StructField("votes", PAIR)]))
    def score(v: pd.Series) -> pd.DataFrame:
        vectors, y, found = sent.value
        x = (np.stack(v.to_numpy()).astype(np.float32).astype(np.float64) - mean) / scale if len(v) else np.zeros((0, len(mean)))
        p, votes = judge(found, x, vectors, np.arange(len(vectors)), y, gamma, classes)
        return pd.DataFrame({"probability": list(p), "votes": list(votes)})

    return score


def judged(made: DataFrame, held: Stored, rows: DataFrame, row_id: str, features: Column, fold: Column | None = None) -> DataFrame:
    """``fold``, ``row_id``, ``probability`` and ``votes`` of every row by its fold's model in ``made``; by the only one without ``fold``."""
    own = rows.select((F.lit(None) if fold is None else fold).cast("string").alias("fold"), F.col(row_id).alias("row_id"), features.cast("array<float>").alias("x"))
    most = own.groupBy("fold").count().agg(F.max("count")).first()[0] or 0
    pieces = max(1, -(-most // SCORED_ROWS))
    own = own.withColumn("piece", F.pmod(F.xxhash64("row_id"), F.lit(pieces)).cast("int"))
    dealt = made.select(F.col("fold").alias("of"), "model", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("of_piece"))
    copies = held.chunks.crossJoin(F.broadcast(dealt.select("of", "of_piece")))
    theirs = dealt.withColumn("chunk", F.lit(None).cast("binary")).unionByName(copies.withColumn("model", F.lit(None).cast("string")))
    kind, more = rows.schema[row_id].dataType.simpleString(), (held.classes, held.C, held.balanced)

    def run(mine: pa.Table, made: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return pa.table({"fold": pa.array([], pa.string()), "row_id": mine.column("row_id"), "probability": pa.array([], pa.list_(pa.float64())), "votes": pa.array([], pa.list_(pa.float64()))})
        s, name = Sample(*boost.opened(made), *more), mine.column("fold")[0].as_py()
        _, mean, scale, gamma, _ = s.view(name)
        x = mine.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(mine.num_rows, -1)
        found = json.loads(made.column("model").drop_null()[0].as_py())
        used = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.array(m["ids"], np.int64) for m in found)]))
        position = np.zeros(len(s.y), np.int64)
        position[used] = np.arange(len(used))
        p, votes = judge(found, (x - mean) / scale, s.rows(name, used), position, s.y[used], gamma, s.classes)
        return pa.table({"fold": mine.column("fold"), "row_id": mine.column("row_id"), "probability": pa.array(list(p), pa.list_(pa.float64())), "votes": pa.array(list(votes), pa.list_(pa.float64()))})

    keys = ["fold", "piece"]
    scored = spread(own, keys).groupBy(*keys).cogroup(spread(theirs, ["of", "of_piece"]).groupBy("of", "of_piece")).applyInArrow(run, f"fold string, row_id {kind}, probability array<double>, votes array<double>")
    return scored.withColumnRenamed("row_id", row_id)


def fit_leaving_out(rows: DataFrame, fold: str, row_id: str, features: Column, number: Column, classes: int, width: int, params: dict) -> DataFrame:
    """``fold``, ``row_id``, ``probability`` and ``votes`` of every row, from the model fitted without the row's fold."""
    held = _stored(rows, row_id, features, number, classes, params, F.col(fold))
    names = [r[0] for r in rows.select(F.col(fold).cast("string")).distinct().collect()]
    made = materialise(models(rows.sparkSession, held, names, params), "models")
    return judged(made, held, rows, row_id, features, F.col(fold))
