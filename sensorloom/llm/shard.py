"""Contiguous shards of nearly equal bytes: the smallest capacity that a greedy cut can keep to.

Rows with equal text are one atomic group. Groups are ordered by the first 60 bits of the text's SHA-256
(null texts come first, as one group) and cut into ``shards`` contiguous ranges so that the fullest range is as small
as any contiguous cut allows. The capacity is found by binary search; the check fills shard after shard
greedily and counts them.

The driver never holds the groups. It holds a summary: ranges of the order ("leaves") with their bytes and
number of groups. A leaf that a cut may fall into is split into ``FAN`` finer leaves by one aggregation, until
the optimum is certain: treating leaves as indivisible gives a capacity that is surely feasible, treating
them as liquid one that nothing can beat, and the search ends when both agree. The summary
grows with the number of shards and the logarithm of the number of groups.

Slots number a shard's rows without gaps, in the order (key, id). Rows are range-partitioned by that order, so a
large group is spread over tasks; a small table of counts per (task, shard) turns places into slots.

Defined results: a null text has no bytes and CRC-32 0; repeated rows are separate rows of one group with
slots of their own; a null id is allowed and sorts first; an empty table gives an empty table; other
columns are not carried over. With fewer groups than shards the last shards stay empty.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import stage

KEY_BITS = 60
FIRST_BITS = 10
FAN_BITS = 4
ROW_BYTES = 16


@dataclass(frozen=True)
class Leaf:
    """A range of the order: keys whose top ``bits`` bits are ``prefix``."""

    bits: int
    prefix: int
    size: int
    groups: int

    @property
    def start(self) -> int:
        return self.prefix << (KEY_BITS - self.bits)


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id``, ``size``, ``crc`` and ``at``, the place of the row's group in the order."""
    raw = F.encode(F.col(text), "UTF-8")
    hashed = F.conv(F.substring(F.sha2(raw, 256), 1, KEY_BITS // 4), 16, 10).cast("long")
    return docs.select(
        F.col(key).alias("id"), (F.coalesce(F.octet_length(raw), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("crc"), F.coalesce(hashed, F.lit(-1)).alias("at"),
    )


def summary(groups: DataFrame, bits: int) -> list[Leaf]:
    """Leaves of ``groups`` (``at``, ``size``) at a depth, in order."""
    cells = groups.groupBy(F.shiftright("at", KEY_BITS - bits).alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    return sorted((Leaf(bits, r["prefix"], r["size"], r["n"]) for r in cells.collect()), key=lambda x: x.start)


def greedy(leaves: list[Leaf], capacity: int) -> list[int]:
    """Where shards after the first start (places in ``leaves``), when no leaf may be cut."""
    starts, used = [], 0
    for i, leaf in enumerate(leaves):
        if used and used + leaf.size > capacity:
            starts.append(i)
            used = 0
        used += leaf.size
    return starts


def fits(leaves: list[Leaf], capacity: int, shards: int, whole: bool) -> bool:
    """Can the leaves be put into ``shards`` shards of this capacity? If not ``whole``, a leaf of several
    groups may be cut anywhere; that answers yes at least as often as the groups themselves allow."""
    used, count = 0, 1
    for leaf in leaves:
        if whole or leaf.groups == 1:
            if leaf.size > capacity:
                return False
            if used + leaf.size > capacity:
                count, used = count + 1, 0
            used += leaf.size
        else:
            rest = leaf.size - (capacity - used)
            if rest <= 0:
                used += leaf.size
            else:
                count += -(-rest // capacity)
                used = rest - (-(-rest // capacity) - 1) * capacity
    return count <= shards


def least_capacity(leaves: list[Leaf], shards: int, whole: bool) -> int:
    low, high = max(1, -(-sum(x.size for x in leaves) // shards)), max(1, sum(x.size for x in leaves))
    while low < high:
        middle = (low + high) // 2
        if fits(leaves, middle, shards, whole):
            high = middle
        else:
            low = middle + 1
    return low


def borders(leaves: list[Leaf], capacity: int, whole: bool) -> set[int]:
    """The leaves in which, or before which, a shard ends."""
    used, found = 0, set()
    for i, leaf in enumerate(leaves):
        if used + leaf.size <= capacity:
            used += leaf.size
            continue
        found.add(i)
        if whole or leaf.groups == 1:
            used = leaf.size
        else:
            rest = leaf.size - (capacity - used)
            used = rest - (-(-rest // capacity) - 1) * capacity
    return found


def cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The least capacity and the first key of every shard but the first. ``groups``: ``at`` and ``size``, one row per group."""
    leaves = summary(groups, FIRST_BITS)
    while True:
        surely, hardly = least_capacity(leaves, shards, True), least_capacity(leaves, shards, False)
        if surely == hardly:
            return surely, [leaves[i].start for i in greedy(leaves, surely)]
        # Between the cuts of both answers lies every cut that may come out: split those leaves.
        low, high = sorted(borders(leaves, hardly, False)), sorted(borders(leaves, surely, True))
        split = set(low) | set(high)
        for a, b in zip(low, high):
            split |= set(range(min(a, b), max(a, b) + 1))
        split = {i for i in split if leaves[i].groups > 1 and leaves[i].bits < KEY_BITS} or {max(range(len(leaves)), key=lambda i: (leaves[i].groups > 1, leaves[i].size))}
        by_depth: dict[int, list[int]] = {}
        for i in split:
            by_depth.setdefault(leaves[i].bits, []).append(leaves[i].prefix)
        fine = [x for i, x in enumerate(leaves) if i not in split]
        for bits, prefixes in by_depth.items():
            inside = groups.where(F.shiftright("at", KEY_BITS - bits).isin(prefixes))
            fine += summary(inside, min(KEY_BITS, bits + FAN_BITS))
        leaves = sorted(fine, key=lambda x: x.start)


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``size``, ``text_crc32``, ``shard``, ``slot``, and ``capacity``, the bytes of the fullest shard."""
    rows = stage(
        keyed(docs, key, text).repartitionByRange("at", "id").sortWithinPartitions("at", "id")
        .withColumn("task", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "rows",
    )
    capacity, starts = cuts(stage(rows.groupBy("at").agg(F.sum("size").alias("size")), "groups"), shards)
    place = F.lit(0)
    for s in starts:  # one comparison per shard
        place = place + (F.col("at") >= s).cast("int")
    placed = rows.withColumn("shard", place)
    counts = placed.groupBy("task", "shard").agg(F.min("place").alias("first"), F.count("*").alias("n"))  # tasks + shards rows at most
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("task", "shard", (before - F.col("first")).alias("shift"))
    return placed.join(offsets, ["task", "shard"]).select(
        F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") + F.col("shift")).alias("slot"), F.lit(capacity).cast("long").alias("capacity"),
    )


def shard_of(starts: list[int], at: int) -> int:
    """The shard of a group's key, for callers that place single rows."""
    return bisect_right(starts, at)
