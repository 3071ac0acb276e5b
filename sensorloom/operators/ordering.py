"""Per-key ordered computations that stay parallel when one key holds most of the rows.

A plain window function sorts a whole key in one task. Where the (estimated) table would not fit
one task, the key is cut into consecutive order blocks: the window runs per (key, block), and a
small per-block table carries what crosses the block borders.
"""

from __future__ import annotations

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorloom.session import split_count

BLOCK = "__block"
RN = "__rn"
BEFORE = "__before"
HASH_BITS = 60


def order_blocks(df: DataFrame, leading: Column, target_bytes: int | None = None) -> tuple[DataFrame, bool]:
    """Add the block column, a monotone function of the leading order expression.

    Small tables get no column. Borders are quantiles of the data, at most 4,096 numbers; they are
    fitted once, so every branch of the plan sees the same blocks.
    """
    n = split_count(df, target_bytes)
    if n == 1:
        return df, False
    ranked = df.withColumn("__lead", leading.cast("double"))
    fitted = QuantileDiscretizer(
        numBuckets=n, inputCol="__lead", outputCol=BLOCK, relativeError=min(0.01, 0.25 / n), handleInvalid="keep",
    ).fit(ranked)
    # Missing values sort first, so they get a block of their own before all others.
    block = F.when(F.col("__lead").isNull(), -1).otherwise(F.col(BLOCK).cast("int"))
    return fitted.transform(ranked).withColumn(BLOCK, block).drop("__lead"), True


def hash_blocks(df: DataFrame, hashed: str, target_bytes: int | None = None) -> tuple[DataFrame, bool]:
    """Blocks for an order by :func:`hash_order`: its top bits, so no statistics are needed."""
    n = split_count(df, target_bytes)
    if n == 1:
        return df, False
    bits = (n - 1).bit_length()
    return df.withColumn(BLOCK, F.shiftright(F.col(hashed), HASH_BITS - bits).cast("int")), True


def _offsets(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    earlier = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    return (
        df.groupBy(*keys, BLOCK).agg(value.alias("__v"))
        .select(*keys, BLOCK, F.coalesce(F.sum("__v").over(earlier), F.lit(0)).alias(BEFORE))
    )


def _carried(df: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``df`` with what ``carried`` has for their key and block; a null key is a key like others."""
    own = [*keys, BLOCK]
    theirs = carried.withColumnsRenamed({k: f"__of_{k}" for k in own})
    return df.join(theirs, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in own]).drop(*[f"__of_{k}" for k in own])


def dense_position(
    df: DataFrame, keys: list[str], order: list[Column], *, pos: str = "pos", blocked: bool = False,
) -> DataFrame:
    """Zero-based consecutive position inside each key."""
    if not blocked:
        w = W.partitionBy(*keys).orderBy(*order)
        return df.withColumn(pos, (F.row_number().over(w) - 1).cast("long"))
    w = W.partitionBy(*keys, BLOCK).orderBy(*order)
    return (
        _carried(df.withColumn(RN, F.row_number().over(w)), _offsets(df, keys, F.count(F.lit(1))), keys)
        .withColumn(pos, (F.col(BEFORE) + F.col(RN) - 1).cast("long"))
        .drop(RN, BEFORE, BLOCK)
    )


def previous_value(
    df: DataFrame, keys: list[str], order: list[str], cols: dict[str, str], *, blocked: bool = False,
) -> DataFrame:
    """``lag`` by one row for each ``{column: output}``, in ascending order of plain columns."""
    if not blocked:
        w = W.partitionBy(*keys).orderBy(*order)
        for c, out in cols.items():
            df = df.withColumn(out, F.lag(c).over(w))
        return df
    w = W.partitionBy(*keys, BLOCK).orderBy(*order)
    for c, out in cols.items():
        df = df.withColumn(out, F.lag(c).over(w))
    df = df.withColumn(RN, F.row_number().over(w))
    across = W.partitionBy(*keys).orderBy(BLOCK)
    tails = (
        df.groupBy(*keys, BLOCK)
        .agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("__tail"))
        .select(*keys, BLOCK, F.lag("__tail").over(across).alias("__tail"))
    )
    df = _carried(df, tails, keys)
    for c, out in cols.items():
        df = df.withColumn(out, F.when(F.col(RN) == 1, F.col(f"__tail.{c}")).otherwise(F.col(out)))
    return df.drop(RN, "__tail", BLOCK)


def running_before(
    df: DataFrame, keys: list[str], order: list[Column], value: str, out: str, *, blocked: bool = False,
) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the key."""
    if not blocked:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
    w = W.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        _carried(df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0))), _offsets(df, keys, F.sum(value)), keys)
        .withColumn(out, F.col(out) + F.col(BEFORE))
        .drop(BEFORE, BLOCK)
    )


def hash_order(df: DataFrame, key: list[str], seed: int, out: str = "__h") -> DataFrame:
    """A reproducible shuffle order: 60 bits of a seeded digest of the row key. MD5 rather than a
    Spark-only hash, so any engine can repeat the split."""
    return df.withColumn(out, digest([F.col(k) for k in key], seed))


def digest(parts: list[Column], seed: int) -> Column:
    text = F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")
