"""Cut long series into chunks with a halo, so a serial filter runs as many bounded groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.session import spread

CHUNK = "chunk"


def with_halo(series: DataFrame, chunk: int, halo: int, pos: str = "pos") -> DataFrame:
    """Copy each row to its own chunk and to every chunk whose halo it lies in."""
    p = F.col(pos)
    first = F.greatest(F.floor((p - halo) / chunk), F.lit(0)).cast("long")
    last = F.floor((p + halo) / chunk).cast("long")
    return series.withColumn(CHUNK, F.explode(F.sequence(first, last)))


def in_groups(df: DataFrame, keys: list[str], pos: str, run: Callable[[pa.RecordBatch, dict[str, np.ndarray]], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """``run`` on every group of ``keys``, in order of ``pos``: the group's rows, and its plain columns as arrays. Groups follow one another in the sorted rows of a
    task, which holds a batch and a group; a data frame sent for each would cost more than the work on a short series."""
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.StringType)) and not isinstance(f.dataType, T.DecimalType) and f.name not in keys[:1]]

    def groups(batch: pa.RecordBatch) -> np.ndarray:
        codes = [pc.fill_null(batch.column(k).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows - 1, bool)
        for c in codes:
            new |= c[1:] != c[:-1]
        return np.concatenate([[0], np.flatnonzero(new) + 1])

    def made(batch: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One batch out for all whole groups of one."""
        arrays = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in plain}
        out = [run(batch.slice(a, b - a), {c: v[a:b] for c, v in arrays.items()}) for a, b in zip(starts, [*starts[1:], batch.num_rows])]
        out = [o for o in out if o.num_rows]
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            starts = groups(batch)
            held = batch.slice(starts[-1])
            if len(starts) > 1:
                yield from made(batch.slice(0, starts[-1]), starts[:-1])
        if held is not None:
            yield from made(held, np.zeros(1, np.int64))

    return spread(df, keys).sortWithinPartitions(*keys, pos).mapInArrow(each, schema)
