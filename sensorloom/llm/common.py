"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from sensorloom.session import materialise

# The whitespace that ends a word: space and the controls 9 to 13. Everything else is part of a word.
SPACE = "[\\x20\\x09-\\x0D]+"
# Bytes of text that a task works on at a time.
PIECE_BYTES = 8 << 20
PAUSE_S = 0.5
WAIT_MS = 60_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def stage(df: DataFrame, kind: str) -> DataFrame:
    """Write a step to the shared folder, read it back, and let Spark drop the shuffle files behind it.

    Spark deletes shuffle files when the driver's JVM collects the plan that made them; asking for that
    after each written step keeps the peak disk use at one step, not at the sum of all. The event queue
    holds the finished plan until it is empty, hence the wait.
    """
    out = materialise(df, kind)
    gc.collect()
    context = df.sparkSession.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(WAIT_MS)
    time.sleep(PAUSE_S)
    context._jvm.System.gc()
    return out


def drop(staged: DataFrame) -> None:
    """Delete the files of a written step that nothing reads any more."""
    spark = staged.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in staged.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with about ``limit`` bytes of text each, at least one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            yield batch.slice(start, end - start)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of all texts in order, and the row each belongs to. Null texts have none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    return rows[full.to_numpy(zero_copy_only=False)], flat.filter(full)


def word_codes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number equal words alike; returns the number of each word and the distinct words."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash per word, the same in every task."""
    import xxhash

    codes, distinct = word_codes(words)
    table_ = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))
    return table_[codes] if len(table_) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of slices of ``values``; ``ends`` holds the borders, starting with 0."""
    width = values.dtype.itemsize
    offsets = pa.py_buffer((ends * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values).tobytes())])


class Remembered:
    """What a function gives for each string, computed once while it is remembered.

    Two generations of at most ``most`` strings each: a full young one becomes the old one, and what is used again moves to
    the young one. Strings longer than ``longest`` are never held, so memory has a fixed bound. Forgetting changes the speed only. The function is passed to each call: held here, a method
    of the owner would make a cycle, and owners of ended tasks would stay in a reused Python worker.
    """

    def __init__(self, most: int = 200_000, longest: int = 64):
        self.most, self.longest = most, longest
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def get(self, strings: list[str], work) -> list:
        young, old = self.young, self.old
        out = [young.get(s) for s in strings]
        missing = [i for i, v in enumerate(out) if v is None]
        new = []
        for i in missing:
            s = strings[i]
            v = old.get(s)
            if v is None:
                new.append(i)
            else:
                out[i] = v
                young[s] = v
        if new:
            for i, v in zip(new, work([strings[i] for i in new])):
                out[i] = v
                if len(strings[i]) <= self.longest:
                    young[strings[i]] = v
        if len(young) > self.most:
            self.old, self.young = (young, {}) if len(young) <= 2 * self.most else ({}, {})
        return out


def gather(flat: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Lay the stretches of ``flat`` (of the given lengths, one behind the other) out in the order of ``codes``."""
    taken = lengths[codes]
    first = (np.cumsum(lengths) - lengths)[codes] - (np.cumsum(taken) - taken)
    return flat[np.arange(taken.sum()) + np.repeat(first, taken)]


def running(df: DataFrame, part: str, order: str, **totals: str) -> DataFrame:
    """Add exclusive running totals over (``part``, ``order``). The rows of a part are summed in a window of their own; only one
    row per part, and parts are numbered by tasks, goes through a window over all."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    sums = df.groupBy(F.col(part).alias("_part")).agg(*[F.sum(v).alias(f"_{k}") for k, v in totals.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in totals])
    within = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = df.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"_own_{k}") for k, v in totals.items()])
    joined = own.join(sums, F.col(part) == F.col("_part"))
    return joined.select(*df.columns, *[(F.col(f"_{k}") + F.col(f"_own_{k}")).alias(k) for k in totals])
