"""Merkle manifest of a table: leaves, a tree per source, a tree over the sources, and a proof for every row.

Rows are numbered within their source in key order by range partitions. Every ``fanout ** levels`` consecutive
leaves of a source are a unit: an aligned part of the tree that one group of rows can hash on its own. Then the units swap
subtree roots in rounds, as in a butterfly: in each round the members of up to ``fanout`` neighbouring
groups send their group's root to one another, and every receiver hashes the common ancestor for itself. A unit receives
at most ``fanout`` digests a round. After the last round each unit knows all siblings on its way to the root, and nothing has to be
passed down the tree. The same rounds run on over the sources, where a group is all units of neighbouring sources.

Member j of a group sends to member j of each other group; where groups differ in size, the smaller one takes turns (to j, j + size, ...). What a
round needs to know of the groups is their first unit and their size, which follow from the row counts of the sources.

Digests are lower-case hex SHA-256 of concatenated hex digests. While a level has several nodes, each run of ``fanout`` nodes
becomes one, the last run even if it holds one node.

Defined results: a null field is hashed as ``-``; null sources and null keys come first; rows with one key stand in the order of
their leaves, and repeated rows one behind the other, with equal leaves and proofs of their own; a lone leaf is its source's root, and a lone
source's root is the root; an empty table gives no rows; other columns are carried along only if named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm.common import running, stage

FANOUT = 16
LEVELS = 3  # levels hashed within a unit: 4,096 leaves
SALTS = 64  # parts into which a source's units are dealt when they meet the source's figures


def leaf(*fields: str | Column) -> Column:
    """Digest of a row: of each field its UTF-8 byte count, a colon and its value, or ``-`` where it is null."""
    texts = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def height(n: int, fanout: int = FANOUT) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


# --- Numbering ---------------------------------------------------------------------------------


def numbered(rows: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Leaves with ``place`` in their source, ``n`` (leaves of the source), ``source_no`` and ``first_unit`` (units of
    the sources before). ``rows``: source, key, leaf, kept."""
    spread = rows.withColumn("spread", F.monotonically_increasing_id())  # repeated rows don't meet in one task
    order = [F.asc_nulls_first("source"), F.asc_nulls_first("key"), F.asc("leaf"), F.asc("spread")]
    # Once written, a row's file place is fixed, however often tasks are lost.
    sorted_ = stage(spread.repartitionByRange(*order).sortWithinPartitions(*order).drop("spread").withColumn("at", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("at", 33)
    runs = sorted_.groupBy(part.alias("part"), "source").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    over = Window.partitionBy("source")
    runs = runs.select(
        "*", F.sum("rows").over(over).alias("n"),
        F.coalesce(F.sum("rows").over(over.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    # A source counts where it begins.
    starts = (F.col("before") == 0).cast("long")
    runs = running(runs.withColumn("starts", starts).withColumn("units", starts * units_of(F.col("n"), fanout, levels)), "part", "first", source_no="starts", first_unit="units")
    begun = F.when(F.col("before") == 0, F.struct("source_no", "first_unit"))
    runs = runs.withColumn("begun", F.max(begun).over(over))
    own = runs.select(F.col("part").alias("_part"), F.col("source").alias("_source"), "first", "n", "before", "begun.*")
    joined = sorted_.join(own, (part == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
    return joined.select("source", "key", "leaf", "kept", "n", "source_no", "first_unit", (F.col("at") - F.col("first") + F.col("before")).alias("place"))


def units_of(n: Column, fanout: int, levels: int) -> Column:
    return F.ceil(n / F.lit(fanout**levels)).cast("long")


# --- Within a unit -----------------------------------------------------------------------------


def _levels(leaves: list[str], up: int, fanout: int) -> list[list[str]]:
    """The nodes of each level, from the leaves to ``up`` levels above."""
    from hashlib import sha256

    out = [leaves]
    for _ in range(up):
        last = out[-1]
        out.append([sha256("".join(last[i : i + fanout]).encode()).hexdigest() for i in range(0, len(last), fanout)])
    return out


def unit_roots(leaves: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``unit``, ``root`` of the subtree over each unit's leaves."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        up = min(levels, height(group.column("n")[0].as_py(), fanout))
        return pa.table({"unit": group.column("unit").slice(0, 1), "root": [_levels(group.column("leaf").to_pylist(), up, fanout)[-1][0]]})

    return leaves.select("unit", "place", "leaf", "n").groupBy("unit").applyInArrow(run, "unit long, root string")


# --- Butterfly rounds --------------------------------------------------------------------------


def layout(leaves: DataFrame, fanout: int, levels: int, n_sources: int) -> DataFrame:
    """Per source: its units and, for each level of the tree over sources, first unit and size of the groups that meet there."""
    found = leaves.where("place = 0").select("source_no", "first_unit", units_of(F.col("n"), fanout, levels).alias("units")).withColumn("meets", F.array().cast("array<array<struct<no:long,first:long,size:long>>>"))
    groups, width = found.select(F.col("source_no").alias("no"), F.col("first_unit").alias("first"), F.col("units").alias("size")), 1
    for _ in range(height(n_sources, fanout)):
        above = F.floor(F.col("no") / fanout).alias("above")
        meet = groups.groupBy(above).agg(F.sort_array(F.collect_list(F.struct("no", "first", "size"))).alias("meet"))
        width *= fanout
        found = found.join(meet, F.floor(F.col("source_no") / width) == F.col("above")).select("source_no", "first_unit", "units", F.array_append("meets", F.col("meet")).alias("meets"))
        groups = meet.select(F.col("above").alias("no"), F.col("meet")[0]["first"].alias("first"), F.aggregate("meet", F.lit(0).cast("long"), lambda a, g: a + g["size"]).alias("size"))
    return found


def exchange(units: DataFrame, groups: Column, own: Column) -> DataFrame:
    """One round. ``groups``: the groups that meet (first, size), one entry where there is nothing to meet; ``own``: the place of the
    unit's group in them. Each unit sends its group's root on, takes one root of every group, hashes the ancestor and notes its siblings."""
    ready = units.select("*", groups.alias("groups"), own.cast("int").alias("own"))
    state = F.struct(*units.columns, "own")
    sends = ready.select("unit", "root", "own", state.alias("state"), F.col("groups")[F.col("own")].alias("mine"), F.posexplode("groups").alias("to", "group"))
    rank = F.col("unit") - F.col("mine.first")
    targets = F.when(rank < F.col("group.size"), F.sequence(F.col("group.first") + rank, F.col("group.first") + F.col("group.size") - 1, F.col("mine.size"))).otherwise(F.array().cast("array<long>"))
    sent = sends.select("unit", "own", "root", "state", F.explode(targets).alias("target"))
    came = sent.groupBy("target").agg(
        F.sort_array(F.collect_list(F.struct("own", "root"))).alias("run"),
        F.first(F.when(F.col("target") == F.col("unit"), F.col("state")), ignorenulls=True).alias("state"),
    )
    alone = F.size("run") == 1
    root = F.sha2(F.concat_ws("", F.col("run.root")), 256)
    step = F.struct(F.col("state.own").alias("place"), F.size("run").alias("size"), F.concat_ws("", F.filter("run", lambda r: r["own"] != F.col("state.own"))["root"]).alias("siblings"))
    kept = [F.col(f"state.{c}").alias(c) for c in units.columns if c not in ("root", "steps")]
    return came.select(*kept, root.alias("hashed"), F.col("state.root").alias("old"), F.col("state.steps").alias("steps"), step.alias("step"), alone.alias("alone"))


def _round(units: DataFrame, groups: Column, own: Column, active: Column) -> DataFrame:
    """A round in which inactive units only keep what they have."""
    alone = F.array(F.struct(F.col("unit").alias("first"), F.lit(1).cast("long").alias("size")))
    swapped = exchange(units.withColumn("active", active), F.when(active, groups).otherwise(alone), F.when(active, own).otherwise(F.lit(0)))
    columns = [c for c in units.columns if c not in ("root", "steps")]
    return swapped.select(
        *columns, F.when(F.col("active"), F.col("hashed")).otherwise(F.col("old")).alias("root"),
        F.when(F.col("active"), F.array_append("steps", F.col("step"))).otherwise(F.col("steps")).alias("steps"),
    )


def upper_proofs(units: DataFrame, fanout: int, rounds: int, source_rounds: int) -> DataFrame:
    """All rounds. ``units``: unit, root, source_no, first_unit, units (of the source), meets. Adds subroot, root and steps."""
    state = units.withColumn("steps", F.array().cast("array<struct<place:int,size:int,siblings:string>>"))
    block = F.col("unit") - F.col("first_unit")
    width = 1
    for _ in range(rounds):
        group = F.floor(block / width)
        first = F.floor(group / fanout) * fanout
        last = F.least(first + fanout, F.ceil(F.col("units") / width)) - 1
        groups = F.transform(F.sequence(first, last), lambda g: F.struct((F.col("first_unit") + g * width).cast("long").alias("first"), F.least(F.lit(width), F.col("units") - g * width).cast("long").alias("size")))
        state, width = _round(state, groups, group - first, F.col("units") > width), width * fanout
    state, width = state.withColumn("subroot", F.col("root")), 1
    for t in range(source_rounds):
        group = F.floor(F.col("source_no") / width)
        groups = F.transform(F.col("meets")[t], lambda g: F.struct(g["first"].alias("first"), g["size"].alias("size")))
        state, width = _round(state, groups, group % fanout, F.lit(True)), width * fanout
    return state.select("unit", "subroot", "root", "steps")


# --- Proofs ------------------------------------------------------------------------------------

PROOF = "leaf string, subroot string, root string, siblings string, places array<int>, sizes array<int>"


def fold(node: str, siblings: str, places: list[int], sizes: list[int]) -> str:
    """The root that follows from a leaf's digest and its siblings."""
    from hashlib import sha256

    done = 0
    for place, size in zip(places, sizes):
        middle, end = done + 64 * place, done + 64 * (size - 1)
        node, done = sha256(f"{siblings[done:middle]}{node}{siblings[middle:end]}".encode()).hexdigest(), end
    return node



def proofs(
    rows: DataFrame, source: str, key: str, leaf_: Column, keep: tuple[str, ...] = (), fanout: int = FANOUT, levels: int = LEVELS, check: Column | None = None,
) -> DataFrame:
    """``source``, ``key``, the ``keep`` columns and a proof per row: ``leaf``, ``subroot``, ``root``, ``siblings`` (all sibling digests from the
    leaf up, left to right, one behind the other), and per level ``places`` (the row's node in its run) and ``sizes`` (of the run). With ``check``, the digest of each row as found elsewhere, also
    ``folded_root``, the root that follows from it and the row's siblings; ``folded`` does the same with stored proofs."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    own = rows.select(F.col(source).alias("source"), F.col(key).alias("key"), leaf_.alias("leaf"), F.struct((F.lit(None).cast("string") if check is None else check).alias("_check"), *keep).alias("kept"))
    unit = F.col("first_unit") + F.floor(F.col("place") / fanout**levels)
    leaves = stage(numbered(own, fanout, levels).withColumn("unit", unit.cast("long")), "leaf_places")
    most, n_sources = leaves.agg(F.max("n"), F.max("source_no") + 1).first()
    plan = layout(leaves, fanout, levels, n_sources or 0)
    # A large source's units are dealt over several copies of its row.
    plan = plan.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("units"), F.lit(SALTS)) - 1)))
    roots = unit_roots(leaves, fanout, levels)
    where = leaves.where(F.col("place") % fanout**levels == 0).select("unit", "source_no", ((F.col("unit") - F.col("first_unit")) % SALTS).alias("salt"))
    units = roots.join(where, "unit").join(plan, ["source_no", "salt"]).drop("salt")
    upper = stage(upper_proofs(units, fanout, height(-(-(most or 0) // fanout**levels), fanout), height(n_sources or 0, fanout)), "upper_proofs")

    def run(group: pa.Table, above: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        n, digests = group.column("n")[0].as_py(), group.column("leaf").to_pylist()
        up = min(levels, height(n, fanout))
        tree, first = _levels(digests, up, fanout), group.column("place")[0].as_py()
        top = above.to_pylist()[0]
        high = "".join(s["siblings"] for s in top["steps"])
        high_places, high_sizes = [s["place"] for s in top["steps"]], [s["size"] for s in top["steps"]]
        joined = ["".join(nodes) for nodes in tree[:-1]]
        checks = group.column("kept").combine_chunks().field("_check").to_pylist()
        siblings, places, sizes, ends = [], [], [], []
        for i in range(len(digests)):
            parts, own_places, own_sizes, node = [], [], [], i
            for nodes, text in zip(tree, joined):
                begin = node - node % fanout
                end = min(begin + fanout, len(nodes))
                parts += [text[64 * begin : 64 * node], text[64 * node + 64 : 64 * end]]
                own_places.append(node - begin)
                own_sizes.append(end - begin)
                node //= fanout
            siblings.append("".join([*parts, high]))
            ends.append(None if checks[i] is None else fold(checks[i], siblings[-1], own_places + high_places, own_sizes + high_sizes))
            places.append(own_places + high_places)
            sizes.append(own_sizes + high_sizes)
        same = len(digests)
        return pa.table({
            "source": group.column("source"), "key": group.column("key"), "kept": group.column("kept"), "leaf": group.column("leaf"), "subroot": [top["subroot"]] * same, "root": [top["root"]] * same,
            "siblings": siblings, "places": pa.array(places, pa.list_(pa.int32())), "sizes": pa.array(sizes, pa.list_(pa.int32())), "folded_root": pa.array(ends, pa.string()),
        })

    kept_type = own.schema["kept"].dataType.simpleString()
    schema = f"source {kinds[source]}, key {kinds[key]}, kept {kept_type}, {PROOF}, folded_root string"
    found = leaves.select("unit", "place", "n", "source", "key", "kept", "leaf").groupBy("unit").cogroup(upper.groupBy("unit")).applyInArrow(run, schema)
    named = [c for c in (source, key) if c not in keep]
    return found.select(*[F.col("source" if c == source else "key").alias(c) for c in named], *[F.col(f"kept.{c}").alias(c) for c in keep], *[c.split()[0] for c in PROOF.split(", ")], *(["folded_root"] if check is not None else []))


@F.pandas_udf(T.StringType())
def folded(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The root that follows from a leaf and its siblings (siblings, places and sizes of a proof)."""
    for digests, siblings, places, sizes in batches:
        yield pd.Series([fold(d, s, p.tolist(), n.tolist()) for d, s, p, n in zip(digests, siblings, places, sizes)], dtype=object)


def sources(proved: DataFrame, source: str = "source") -> DataFrame:
    """The manifest's short form: rows and subtree root per source, and the root."""
    return proved.groupBy(source).agg(F.count("*").alias("rows"), F.first("subroot").alias("subroot"), F.first("root").alias("root"))
