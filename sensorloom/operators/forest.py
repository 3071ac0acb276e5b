"""Random forests with a least node size to split, and many such forests in one job.

A tree takes a bootstrap of the rows and, at each node, a random subset of the features, the square root of their number; where none
of them splits the node, the others are tried in random order. Splits maximise the drop of the weighted Gini impurity
over at most 64 bins a feature. A node is split while it holds ``min_split`` different rows, is impure and lies above ``depth``;
both sides keep ``min_leaf`` different rows. With ``balanced``, a row weighs inversely to the share of its class.

Fitting takes all rows, or with parameter ``most`` the first so many in a hash order, as :func:`boost.gathered` writes them; the unit of work is a block of trees of one
forest, whose task gets a copy of all rows. Its nodes are searched side by side, a node of every tree at a time; so the trees of a single forest grow at once, and so do those of all folds or subjects left out, whatever their
number. A tree depends on its number and the seed only, not on the job it was made in. A forest's probability is the mean over its trees.

The trees grow with the rows, so a forest is a table of packed trees in the shared folder (:func:`fit_table`); rows meet its blocks in groups to be scored.
Only :func:`fit` and :func:`scorer`, for streams, bring the trees to the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.operators.boost import BINS, PIECE_ROWS, beside, bin_edges, binned, gathered, opened

BLOCK_TREES = 10  # at least, grown in one task, which gets a copy of the rows, and sent to one group of rows to be scored
MOST_BLOCK_TREES = 50
SMALL_ROWS = 100  # nodes of up to so many rows are searched together, one of each tree
DEFAULTS = {"min_split": 2, "min_leaf": 1, "balanced": False, "bootstrap": True, "seed": 42}
SENT = "fold string, block int, tree int, packed binary"


# --- Growing -----------------------------------------------------------------------------------


def class_weights(y: np.ndarray, classes: int, balanced: bool) -> np.ndarray:
    """A weight per row: rows / (classes present * rows of its class), or one."""
    if not balanced:
        return np.ones(len(y))
    counts = np.bincount(y, minlength=classes)
    return len(y) / (np.count_nonzero(counts) * np.maximum(counts, 1))[y]


def best_splits(bins: np.ndarray, of: list[np.ndarray], columns: np.ndarray, y: np.ndarray, weights: list[np.ndarray], classes: int, least: int) -> list[tuple[float, int, int]]:
    """For each node its (drop of weight times impurity, feature, last bin of the left side); 0 if there is none. Of equal drops the first column and bin wins.
    ``of`` has the rows of each node, ``columns`` a line of features for each, ``weights`` the weights of its rows. Nodes don't influence each other."""
    k, m = columns.shape
    sizes = np.array([len(o) for o in of])
    rows, node = np.concatenate(of), np.repeat(np.arange(k), sizes)
    place = (bins[rows[:, None], columns[node]] + (node[:, None] * m + np.arange(m)) * BINS).ravel()
    held = np.bincount(place, minlength=k * m * BINS).reshape(k * m, BINS)
    rank = np.cumsum(held > 0, axis=1) - 1  # small nodes have few bins, so only bins with rows take part
    most = int(rank[:, -1].max()) + 1
    place = place // BINS * most + rank.ravel()[place]
    cells = k * m * most
    sums = np.bincount(place + np.repeat(y[rows] * cells, m), np.repeat(np.concatenate(weights), m), cells * classes).reshape(classes, k * m, most)
    count = np.bincount(place, minlength=cells).reshape(k * m, most).cumsum(axis=1)
    left = sums.cumsum(axis=2)
    total = left[:, :, -1:].copy()
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left * left).sum(0) / left.sum(0) + (right * right).sum(0) / right.sum(0) - (total * total).sum(0) / total.sum(0)
    gain = np.where((count >= least) & (np.repeat(sizes, m)[:, None] - count >= least), gain, 0.0).reshape(k, -1)
    at = np.argmax(np.round(gain, 10), axis=1)
    out = []
    for i, j in enumerate(at):
        column, cut = divmod(int(j), most)
        out.append((float(gain[i, j]), int(columns[i, column]), int(np.searchsorted(rank[i * m + column], cut))))
    return out


class Growing:
    """A tree on the way: its own random numbers, the nodes so far and those to do, last one first."""

    def __init__(self, n: int, width: int, y: np.ndarray, classes: int, p: dict, number: int):
        self.rng = np.random.default_rng([p["seed"], number])
        times = np.bincount(self.rng.integers(0, n, n), minlength=n) if p["bootstrap"] else np.ones(n, np.int64)
        self.weight = class_weights(y, classes, p["balanced"]) * times
        self.feature, self.border, self.left, self.chance, self.gains = [-1], [0.0], [0], [None], np.zeros(width)
        self.todo = [(0, np.flatnonzero(times), 0)]

    def node(self, y: np.ndarray, classes: int, p: dict, few: int) -> tuple[int, np.ndarray, int, np.ndarray] | None:
        """The next node that may be split, with its features in random order."""
        while self.todo:
            at, of, depth = self.todo.pop()
            share = np.bincount(y[of], self.weight[of], classes)
            self.chance[at] = share / share.sum()
            if depth < p["depth"] and len(of) >= p["min_split"] and np.count_nonzero(share) > 1:
                width = len(self.gains)
                return at, of, depth, np.arange(width) if few >= width else self.rng.permutation(width)
        return None

    def split(self, at: int, of: np.ndarray, depth: int, found: tuple[float, int, int], bins: np.ndarray, edges: list[np.ndarray]) -> None:
        drop, column, cut = found
        if drop <= 1e-9:
            return
        self.gains[column] += drop
        self.feature[at], self.border[at], self.left[at] = column, float(edges[column][cut]), len(self.feature)
        goes = bins[of, column] <= cut
        for side in (of[goes], of[~goes]):
            self.todo.append((len(self.feature), side, depth + 1))
            self.feature.append(-1), self.border.append(0.0), self.left.append(0), self.chance.append(None)

    def tree(self) -> dict[str, np.ndarray]:
        return {"feature": np.array(self.feature, np.int32), "border": np.array(self.border, np.float32), "left": np.array(self.left, np.int32),
                "chance": np.array(self.chance, np.float64).ravel(), "gains": self.gains / max(self.gains.sum(), 1e-300)}


def grow_all(bins: np.ndarray, edges: list[np.ndarray], y: np.ndarray, classes: int, p: dict, numbers: list[int]) -> list[dict[str, np.ndarray]]:
    """The trees of these numbers, side by side: each step searches the splits of one node of every tree at once, as most nodes are small. The right
    child follows the left one; leaves have feature -1 and a chance per class."""
    n, width = bins.shape
    few = min(width, p.get("columns") or max(1, math.isqrt(width)))
    trees = [Growing(n, width, y, classes, p, number) for number in numbers]

    def search(nodes: list, start: int) -> list[tuple[float, int, int]]:
        found: list = [None] * len(nodes)
        small = [i for i, (_, (_, of, _, _)) in enumerate(nodes) if len(of) <= SMALL_ROWS]
        for part in [small, *([i] for i, (_, (_, of, _, _)) in enumerate(nodes) if len(of) > SMALL_ROWS)]:
            if part:
                of = [nodes[i][1][1] for i in part]
                columns = np.stack([nodes[i][1][3][start : start + few] for i in part])
                for i, f in zip(part, best_splits(bins, of, columns, y, [nodes[i][0].weight[o] for i, o in zip(part, of)], classes, p["min_leaf"])):
                    found[i] = f
        return found

    while nodes := [(t, node) for t in trees if (node := t.node(y, classes, p, few)) is not None]:
        found = search(nodes, 0)
        for start in range(few, width, few):
            again = [i for i, f in enumerate(found) if f[0] <= 1e-9]
            if not again:
                break
            for i, f in zip(again, search([nodes[i] for i in again], start)):
                found[i] = f
        for (t, (at, of, depth, _)), best in zip(nodes, found):
            t.split(at, of, depth, best, bins, edges)
    return [t.tree() for t in trees]


def grow(bins: np.ndarray, edges: list[np.ndarray], y: np.ndarray, classes: int, p: dict, number: int) -> dict[str, np.ndarray]:
    """Tree ``number`` of a forest."""
    return grow_all(bins, edges, y, classes, p, [number])[0]


def leaf_chances(tree: dict[str, np.ndarray], x: np.ndarray, classes: int) -> np.ndarray:
    """(rows, classes): the chances of the leaf that each row reaches."""
    feature, border, left = tree["feature"], tree["border"], tree["left"]
    at = np.zeros(len(x), np.int64)
    moving = np.arange(len(x)) if feature[0] >= 0 else np.zeros(0, np.int64)
    while len(moving):
        node = at[moving]
        at[moving] = left[node] + (x[moving, feature[node]] > border[node])
        moving = moving[feature[at[moving]] >= 0]
    return tree["chance"].reshape(-1, classes)[at]


def pack(tree: dict[str, np.ndarray]) -> bytes:
    """A tree without loss: borders and places of inner nodes only, equal chances once, compressed."""
    inner = tree["feature"] >= 0
    chance = tree["chance"].reshape(len(inner), -1)
    kinds, which = np.unique(chance, axis=0, return_inverse=True)
    parts = [np.array([len(inner), *kinds.shape, len(tree["gains"])], np.int64), tree["feature"], tree["border"][inner], tree["left"][inner],
             which.ravel().astype(np.int32), kinds, tree["gains"]]
    return zlib.compress(b"".join(p.tobytes() for p in parts), 1)


def unpack(packed: bytes) -> dict[str, np.ndarray]:
    data, at = zlib.decompress(packed), 0

    def take(n: int, kind) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, kind, n, at)
        at += found.nbytes
        return found

    n, kinds, classes, width = take(4, np.int64).tolist()
    feature = take(n, np.int32)
    inner = feature >= 0
    border, left = np.zeros(n, np.float32), np.zeros(n, np.int32)
    border[inner], left[inner] = take(int(inner.sum()), np.float32), take(int(inner.sum()), np.int32)
    which = take(n, np.int32)
    return {"feature": feature, "border": border, "left": left, "chance": take(kinds * classes, np.float64).reshape(kinds, classes)[which].ravel(), "gains": take(width, np.float64)}


def packed(models: DataFrame) -> DataFrame:
    """:data:`SENT` rows of a table with a list per part of a tree, as models were once stored."""
    parts = {"feature": np.int32, "border": np.float32, "left": np.int32, "chance": np.float64, "gains": np.float64}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [pack({c: np.asarray(batch.column(c)[i].values.to_numpy(zero_copy_only=False), k) for c, k in parts.items()}) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("fold", "block", "tree")), pa.array(trees, pa.binary())], names=["fold", "block", "tree", "packed"])

    return models.select("fold", "block", "tree", *parts).mapInArrow(run, SENT)


def importances(trees: list[dict[str, np.ndarray]]) -> np.ndarray:
    """The mean over the trees of each feature's share in the drops, summing to 1 if anything was split."""
    mean = np.mean([t["gains"] for t in trees], axis=0)
    return mean / max(mean.sum(), 1e-300)


# --- On tables ---------------------------------------------------------------------------------


def block_trees(spark, forests: int, trees: int) -> int:
    """Trees in a block: the more, the fewer copies of the rows; enough blocks are left for all cores."""
    return max(BLOCK_TREES, min(MOST_BLOCK_TREES, forests * trees // (4 * spark.sparkContext.defaultParallelism)))


def _grown(chunks: DataFrame, names: list[str | None], classes: int, params: dict) -> DataFrame:
    """:data:`SENT` rows of one forest for each of ``names``: of the rows outside that fold, of all for null."""
    p, spark = {**DEFAULTS, **params}, chunks.sparkSession
    size = block_trees(spark, len(names), p["trees"])

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        x, y, folds = opened(held)
        name, block = asked.column("fold")[0].as_py(), asked.column("block")[0].as_py()
        inside = np.ones(len(y), bool) if name is None else folds != name
        if not inside.any():
            raise ValueError(f"no labelled rows outside fold {name}")
        x, y = x[inside], y[inside]
        edges = bin_edges(x, BINS)
        numbers = list(range(block * size, min(p["trees"], (block + 1) * size)))
        trees = [pack(t) for t in grow_all(binned(x, edges), edges, y, classes, p, numbers)]
        n = len(numbers)
        return pa.table({"fold": pa.array([name] * n, pa.string()), "block": pa.array([block] * n, pa.int32()), "tree": pa.array(numbers, pa.int32()), "packed": pa.array(trees, pa.binary())})

    asked = [(name, block) for name in names for block in range(-(-p["trees"] // size))]
    return beside(spark.createDataFrame(asked, "fold string, block int"), ["fold", "block"], chunks, run, SENT)


def fit_table(rows: DataFrame, row_id: str, features: Column, number: Column, classes: int, width: int, params: dict) -> DataFrame:
    """One forest as a written table of :data:`SENT` rows."""
    from sensorloom.session import materialise

    return materialise(_grown(gathered(rows, row_id, features, number, most=params.get("most")), [None], classes, params), "forest")


def fit(rows: DataFrame, row_id: str, features: Column, number: Column, classes: int, width: int, params: dict) -> list[dict[str, np.ndarray]]:
    """The trees of one forest. They reach the driver packed."""
    return fetched(_grown(gathered(rows, row_id, features, number, most=params.get("most")), [None], classes, params))


def fetched(models: DataFrame) -> list[dict[str, np.ndarray]]:
    """The trees of a table of :data:`SENT` rows, on the driver."""
    return [unpack(b.as_py()) for b in models.toArrow().sort_by("tree").column("packed")]


def shares(models: DataFrame) -> DataFrame:
    """(pos, importance): :func:`importances` of a table of :data:`SENT` rows, without its trees on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("packed"):
                gains = unpack(packed.as_py())["gains"]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(gains))), pa.array(gains)], names=["pos", "gain"])

    found = models.select("packed").mapInArrow(run, "pos long, gain double").groupBy("pos").agg(F.avg("gain").alias("gain"))
    whole = found.agg(F.greatest(F.sum("gain"), F.lit(1e-300)).alias("whole"))
    return found.crossJoin(F.broadcast(whole)).select("pos", (F.col("gain") / F.col("whole")).alias("importance"))


def scorer(spark, trees: list[dict[str, np.ndarray]], classes: int):
    """A column of class probabilities from a column of features, for streams. The trees are sent to the tasks once."""
    sent = spark.sparkContext.broadcast([pack(t) for t in trees])

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(np.float32) if len(v) else np.zeros((0, 1), np.float32)
        total = np.zeros((len(x), classes))
        for tree in sent.value:  # one tree at a time is unpacked
            total += leaf_chances(unpack(tree), x, classes)
        return pd.Series(list(total / len(sent.value)), dtype=object)

    return score


def chances(models: DataFrame, rows: DataFrame, row_id: str, features: Column, classes: int, fold: Column | None = None) -> DataFrame:
    """``fold``, ``row_id`` and ``probability`` of every row by its fold's forest of ``models``; by the only one without ``fold``. Rows meet the trees
    by piece and block, and a row's blocks are summed."""
    fold = F.lit(None).cast("string") if fold is None else fold.cast("string")
    pieces, blocks = max(1, -(-rows.count() // PIECE_ROWS)), models.agg(F.max("block")).first()[0] + 1
    dealt = models.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    kind = rows.schema[row_id].dataType.simpleString()
    own = rows.select(fold.alias("fold"), F.pmod(F.xxhash64(row_id), F.lit(pieces)).cast("int").alias("piece"), F.col(row_id).alias("row_id"), features.cast("array<float>").alias("x"))
    own = own.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(mine: pa.Table, made: pa.Table) -> pa.Table:
        found = np.zeros((mine.num_rows, classes))
        if mine.num_rows:
            x = mine.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(mine.num_rows, -1)
            for packed in made.sort_by("tree").column("packed"):  # one tree at a time is unpacked
                found += leaf_chances(unpack(packed.as_py()), x, classes)
        return pa.table({"fold": mine.column("fold"), "row_id": mine.column("row_id"), **{f"p{k}": found[:, k] for k in range(classes)}})

    keys = ["fold", "piece", "block"]
    parts = own.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(run, f"fold string, row_id {kind}, " + ", ".join(f"p{k} double" for k in range(classes)))
    summed = parts.groupBy("fold", "row_id").agg(*[F.sum(f"p{k}").alias(f"p{k}") for k in range(classes)])
    whole = sum((F.col(f"p{k}") for k in range(1, classes)), F.col("p0"))  # equal ids are summed together
    return summed.select("fold", F.col("row_id").alias(row_id), F.array(*[F.col(f"p{k}") / whole for k in range(classes)]).alias("probability"))


def fit_leaving_out(rows: DataFrame, fold: str, row_id: str, features: Column, number: Column, classes: int, width: int, params: dict) -> DataFrame:
    """``fold``, ``row_id`` and ``probability`` of every row, from the forest that was fitted without the row's fold. One job grows all
    trees, one scores."""
    from sensorloom.session import materialise

    chunks = gathered(rows, row_id, features, number, F.col(fold), params.get("most"))
    names = [r[0] for r in rows.select(F.col(fold).cast("string")).distinct().collect()]
    models = materialise(_grown(chunks, names, classes, params), "forests")
    return chances(models, rows, row_id, features, classes, F.col(fold))
