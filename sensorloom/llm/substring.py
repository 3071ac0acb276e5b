"""Repeated passages by recompression: long repeats are found through shared symbols and verified exactly.

Every document is a sequence of words. A round first replaces each run of one symbol by a name for (symbol,
length), then splits all symbols by one bit of their hash into left and right ones and replaces each
neighbouring (left, right) pair by a name for the pair. A name is a hash of what it stands for, so all
tasks name alike without a shuffle. Whether a symbol forms depends only on the words
around it; that stretch is kept as its context. Two equal windows hence have the same symbols at the same
offsets wherever the context lies inside the window, and each window has at least one: a single word.

1. Each window is represented by its weightiest interior symbol: the longest expansion, ties by hash. A
   symbol represents a row of neighbouring windows, so there are far fewer representatives than windows.
2. Spark counts over all documents which symbols occur under more than one id. Only windows
   whose representative does can repeat.
3. Those windows are named by 96 bits over their words, Spark finds the smallest id of each name, and
   windows that also start in a document with a smaller id mark their words.

Hot symbols and windows (a passage in a third of all documents) shrink to one row per task before they are
shuffled; the joins back are skewed on the side that adaptive execution splits. No pairs are formed.
Each step is written to the shared folder.

Defined results: words are runs of anything but space and the controls 9 to 13, unchanged. A null text has
no words. Rows with a null id neither remove nor lose words. Rows with the same id don't remove each
other's words. Repeated rows give repeated results. An empty table gives an empty table. Other columns
are not carried over. Words meet as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import drop, hash_words, mix, pieces, split_words, stage

WIDTH = 13
ROUNDS = 2
PARTS = 3
LONGEST = 3  # symbols of at least so many words weigh the same
SEED = np.uint64(0x9E3779B97F4A7C15)


class Symbols:
    """One level: names with their document, their context [low, high) in words, and how many words they stand for."""

    def __init__(self, name: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray, words: np.ndarray):
        self.name, self.row, self.low, self.high, self.words = name, row, low, high, words

    def beside(self) -> tuple[np.ndarray, np.ndarray]:
        """The low end of the left neighbour's context and the high end of the right one's; beyond a document's end the context leaves it."""
        same = self.row[1:] == self.row[:-1]
        left, right = self.low - 1, self.high + 1
        left[1:][same] = self.low[:-1][same]
        right[:-1][same] = self.high[1:][same]
        return np.minimum(left, self.low), np.maximum(right, self.high)

    def runs(self) -> Symbols:
        left, right = self.beside()
        first = np.ones(len(self.name), bool)
        first[1:] = (self.name[1:] != self.name[:-1]) | (self.row[1:] != self.row[:-1])
        at = np.flatnonzero(first)
        last = np.append(at[1:], len(first)) - 1
        size = last - at + 1
        name = np.where(size > 1, mix(self.name[at] ^ mix(size.astype(np.uint64) + SEED)), self.name[at])
        return Symbols(name, self.row[at], left[at], right[last], np.add.reduceat(self.words, at))

    def pairs(self, turn: int) -> Symbols:
        left, right = self.beside()
        is_left = mix(self.name + mix(np.array([turn], np.uint64))) >> np.uint64(63) == 0
        pair = np.zeros(len(self.name), bool)  # starts a pair
        pair[:-1] = is_left[:-1] & ~is_left[1:] & (self.row[1:] == self.row[:-1])
        second = np.zeros(len(self.name), bool)
        second[1:] = pair[:-1]
        # A lone left symbol depends on its right neighbour, a lone right one on its left neighbour.
        low = np.where(pair | second | is_left, self.low, left)
        high = np.where(pair | second | ~is_left, self.high, right)
        name, words = self.name.copy(), self.words.copy()
        at = np.flatnonzero(pair)
        name[at] = mix(mix(self.name[at] + SEED) * np.uint64(3) + self.name[at + 1])
        words[at] += self.words[at + 1]
        high[at] = np.maximum(self.high[at], self.high[at + 1])
        low[at] = np.minimum(self.low[at], self.low[at + 1])
        stay = ~second
        return Symbols(name[stay], self.row[stay], low[stay], high[stay], words[stay])


def stretch_hashes(words: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of the words of each stretch, from one running sum of powers modulo 2^64."""
    base, inverse = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
    power, back = (np.cumprod(np.append(np.uint64(1), np.full(len(words), b, np.uint64)), dtype=np.uint64) for b in (base, inverse))
    total = np.append(np.uint64(0), np.cumsum(words * power[:-1], dtype=np.uint64))
    return mix((total[high] - total[low]) * back[low] + (high - low).astype(np.uint64))


def representatives(rows: np.ndarray, words: np.ndarray, width: int = WIDTH, rounds: int = ROUNDS) -> np.ndarray:
    """The representative of the window that starts at each word; 0 where none does."""
    n = len(rows)
    best = np.zeros(n, np.uint64)
    if n < width:
        return best
    end = np.searchsorted(rows, rows, "right")
    level = Symbols(words, rows, np.arange(n), np.arange(1, n + 1), np.ones(n, np.int64))
    for turn in range(rounds + 1):
        if turn:
            level = level.runs().pairs(turn)
        low, high = level.low, level.high
        clear = (low >= 0) & (high <= n) & (high - low <= width)
        clear[clear] = (rows[low[clear]] == level.row[clear]) & (rows[high[clear] - 1] == level.row[clear])
        low, high = low[clear], high[clear]
        # The stretch that decides a symbol lies inside the window too, so it may name the window as well as the symbol does.
        weight = (np.minimum(level.words[clear], LONGEST).astype(np.uint64) << np.uint64(61)) | (stretch_hashes(words, low, high) >> np.uint64(3)) | np.uint64(1)
        for k in range(width):
            at = low - k
            inside = (high - at <= width) & (at >= 0)
            inside[inside] = rows[at[inside]] == rows[low[inside]]
            if not inside.any():
                break
            np.maximum.at(best, at[inside], weight[inside])
    best[np.arange(n) + width > end] = 0
    return best


def window_names(words: np.ndarray, at: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit and a 32-bit name over the words of the windows that start at ``at``."""
    a, b = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for k in range(width):
        w = words[at + k]
        a = mix(a + w)
        b = b * np.uint64(0xD6E8FEB86659FD93) + mix(w ^ SEED)
    return a, (mix(b) >> np.uint64(32)).astype(np.uint32)


def _anchors(batches: Iterator[pa.RecordBatch], width: int, rounds: int) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        rows, words = split_words(piece.column("text"))
        best = representatives(rows, hash_words(words), width, rounds)
        first = best != 0
        first[1:] &= (best[1:] != best[:-1]) | (rows[1:] != rows[:-1])
        at = np.flatnonzero(first)
        stop = np.ones(len(best) + 1, bool)
        stop[:-1] = first | (best == 0)
        stops = np.flatnonzero(stop)
        count = stops[np.searchsorted(stops, at, "right")] - at
        start = np.searchsorted(rows, np.arange(piece.num_rows))
        row = pa.array(rows[at])
        yield pa.RecordBatch.from_arrays(
            [pa.array(best[at].view(np.int64)), piece.column("id").take(row), piece.column("hash").take(row), pa.array((at - start[rows[at]]).astype(np.int32)), pa.array(count.astype(np.int32))],
            names=["name", "id", "hash", "at", "n"],
        )


def _windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        rows, words = split_words(piece.column("text"))
        start = np.searchsorted(rows, np.arange(piece.num_rows))
        hits = piece.column("hits")
        owner = pc.list_parent_indices(hits).to_numpy(zero_copy_only=False)
        first, count = (pc.struct_field(hits.flatten(), f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("at", "n"))
        at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        row = np.repeat(owner, count)
        a, b = window_names(hash_words(words), at + start[row], width)
        own = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int32)), piece.column("id").take(own), piece.column("hash").take(own), pa.array(at.astype(np.int32))], names=["a", "b", "id", "hash", "at"],
        )


def _kept(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        totals, removed, kept = [], [], []
        for text, marks in zip(piece.column("text").to_pylist(), piece.column("marks")):
            words = (text or "").encode().split()  # bytes split at exactly space and the controls 9 to 13
            stay = np.ones(len(words), bool)
            if marks.is_valid:
                at = np.asarray(marks.values)
                for k in range(width):
                    stay[at + k] = False
            totals.append(len(words))
            removed.append(int(len(words) - stay.sum()))
            kept.append(b" ".join(words if stay.all() else [words[i] for i in np.flatnonzero(stay)]))
        yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])


def parts(rows: DataFrame, name: str) -> list[DataFrame]:
    """All rows in PARTS blocks of names, one after the other, so that only one block's shuffle is on disk at a time."""
    return [rows.where(F.pmod(F.col(name), F.lit(PARTS)) == p) for p in range(PARTS)]


def dedupe(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """``key``, ``n_words``, ``n_removed`` and ``kept``: the words that no repeated window covers, joined by single spaces."""
    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    hashed = own.withColumn("hash", F.hash("text"))  # tells apart rows that share an id
    known = hashed.where("id IS NOT NULL AND text IS NOT NULL")
    anchors = stage(known.mapInArrow(lambda b: _anchors(b, width, rounds), f"name long, id {kind}, hash int, at int, n int"), "anchors")
    found = []
    for part in parts(anchors, "name"):
        shared = part.groupBy("name").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("name")
        shared = stage(shared, "names")  # a table of its own, so that the join may split hot names
        found.append(stage(part.join(shared, "name", "left_semi").select("id", "hash", "at", "n"), "shared"))
    drop(anchors)
    hits = stage(reduce(DataFrame.union, found).groupBy("id", "hash").agg(F.collect_list(F.struct("at", "n")).alias("hits")), "hits")
    texts = known.join(hits, ["id", "hash"]).select("id", "hash", "text", "hits")
    windows = stage(texts.mapInArrow(lambda b: _windows(b, width), f"a long, b int, id {kind}, hash int, at int"), "windows")
    found = []
    for part in parts(windows, "a"):
        first = part.groupBy("a", "b").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("a", "b", "low")
        first = stage(first, "first")
        found.append(stage(part.join(first, ["a", "b"]).where("id > low").select("id", "hash", "at"), "again"))
    drop(windows)
    marks = stage(reduce(DataFrame.union, found).groupBy("id", "hash").agg(F.collect_list("at").alias("marks")), "marks")
    marked = hashed.join(marks, ["id", "hash"], "left").select("id", "text", "marks")
    out = marked.mapInArrow(lambda b: _kept(b, width), f"id {kind}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", key)
