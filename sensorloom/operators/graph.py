"""Sample graphs as vertex and edge frames.

Node features are plain columns, so a hop is a join and a grouped sum inside codegen; a vertex with
very many edges is pre-summed on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.ordering import digest
from sensorloom.schema import PHASES
from sensorloom.session import materialise

CUT_EVERY = 4  # hops between written stages


def phase_bounds(fs: float, phases: list[tuple] = PHASES) -> list[tuple[str, int, int]]:
    """Named half-open index ranges from minutes."""
    return [(name, int(a * 60 * fs), int(b * 60 * fs)) for name, a, b in phases]


def with_phase(samples: DataFrame, bounds: list[tuple[str, int, int]], pos: str = "pos") -> DataFrame:
    """Add the phase(s) a sample lies in; samples outside every phase drop out.

    The handful of ranges is a literal, so the range join is a narrow filter inside each row.
    """
    table = F.array(*[
        F.struct(F.lit(n).alias("phase"), F.lit(a).cast("long").alias("lo"), F.lit(b).cast("long").alias("hi")) for n, a, b in bounds
    ])
    hits = F.filter(table, lambda p: (F.col(pos) >= p.lo) & (F.col(pos) < p.hi))
    return samples.withColumn("__p", F.explode(hits)).withColumns({"phase": F.col("__p.phase"), "__hi": F.col("__p.hi")}).drop("__p")


def chain_edges(nodes: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """pos -> pos + 1 over densely numbered samples: the length of a key decides, no row needs its
    neighbour."""
    lengths = nodes.groupBy(*keys).agg((F.max(pos) + 1).alias("__n"))
    ahead = nodes.join(lengths, keys).where(F.col(pos) + 1 < F.col("__n"))
    return ahead.select(*keys, F.col(pos).alias("src"), (F.col(pos) + 1).alias("dst"))


def phase_chain(samples: DataFrame, bounds: list[tuple[str, int, int]], keys: list[str], pos: str = "pos") -> DataFrame:
    """Edges between neighbours inside one phase, both directions."""
    lengths = samples.groupBy(*keys).agg((F.max(pos) + 1).alias("__n"))
    inside = with_phase(samples.select(*keys, pos).join(lengths, keys), bounds, pos)
    last = F.least("__hi", "__n")
    forward = inside.where(F.col(pos) + 1 < last).select(*keys, "phase", F.col(pos).alias("src"), (F.col(pos) + 1).alias("dst"))
    return both_ways(forward)


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, without reading the input twice."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    ends = F.array(F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(*rest, F.inline(ends))


def add_self_loops(edges: DataFrame, nodes: DataFrame, keys: list[str], pos: str = "pos", weight: float = 1.0) -> DataFrame:
    loops = nodes.select(*keys, F.col(pos).alias("src"), F.col(pos).alias("dst"))
    if "weight" not in edges.columns:
        edges = edges.withColumn("weight", F.lit(1.0))
    return edges.select(*keys, "src", "dst", "weight").unionByName(loops.withColumn("weight", F.lit(float(weight))))


def degree(edges: DataFrame, keys: list[str]) -> DataFrame:
    """In-degree: the number of edges that end in a vertex."""
    return edges.groupBy(*keys, F.col("dst").alias("node")).agg(F.sum(F.lit(1.0)).alias("degree"))


def _inv_sqrt(d: Column) -> Column:
    return F.when(F.coalesce(d, F.lit(0.0)) > 0, 1 / F.sqrt(d)).otherwise(F.lit(0.0))


def norm_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Symmetric normalisation of each edge weight by the degrees of its two ends."""
    scale = degree(edges, keys).select(*keys, "node", _inv_sqrt(F.col("degree")).alias("__s"))
    at_src = scale.select(*keys, F.col("node").alias("src"), F.col("__s").alias("__a"))
    at_dst = scale.select(*keys, F.col("node").alias("dst"), F.col("__s").alias("__b"))
    joined = edges.join(at_src, [*keys, "src"], "left").join(at_dst, [*keys, "dst"], "left")
    norm = F.coalesce("__a", F.lit(0.0)) * F.col("weight") * F.coalesce("__b", F.lit(0.0))
    return joined.select(*keys, "src", "dst", norm.alias("norm"))


def hop(nodes: DataFrame, normed: DataFrame, keys: list[str], cols: list[str], pos: str = "pos") -> DataFrame:
    """One step of weighted neighbour sums; a vertex without edges becomes 0."""
    feats = nodes.select(*keys, F.col(pos).alias("src"), *cols)
    sums = (
        normed.join(feats, [*keys, "src"])
        .groupBy(*keys, F.col("dst").alias(pos)).agg(*[F.sum(F.col("norm") * F.col(c)).alias(c) for c in cols])
    )
    base = nodes.select(*keys, pos)
    return base.join(sums, [*keys, pos], "left").select(*keys, pos, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in cols])


def propagate(nodes: DataFrame, edges: DataFrame, keys: list[str], cols: list[str], weights: list[float], pos: str = "pos",
              improved: bool = False) -> DataFrame:
    """Weighted sum of 0 .. K-hop neighbour averages over the graph with self-loops."""
    looped = add_self_loops(edges, nodes, keys, pos, 2.0 if improved else 1.0)
    normed = norm_edges(looped, keys)
    if len(weights) > 2:
        normed = materialise(normed, "edges")
    x = nodes.select(*keys, pos, *cols)
    out = x.select(*keys, pos, *[(F.col(c) * weights[0]).alias(c) for c in cols])
    for k, w in enumerate(weights[1:], start=1):
        x = hop(x, normed, keys, cols, pos)
        if k + 1 < len(weights) or k % CUT_EVERY == 0:
            x = materialise(x, "hop")  # read again by the sum and by the next hop
        step = x.select(*keys, pos, *[F.col(c).alias(f"__{c}") for c in cols])
        out = out.join(step, [*keys, pos]).select(
            *keys, pos, *[(F.col(c) + F.col(f"__{c}") * w).alias(c) for c in cols])
    return out


def chebyshev(nodes: DataFrame, edges: DataFrame, keys: list[str], cols: list[str], terms: int = 3, pos: str = "pos") -> DataFrame:
    """Terms T_0 .. T_{K-1} of the rescaled Laplacian (largest eigenvalue taken as 2)."""
    plain = edges.where(F.col("src") != F.col("dst"))
    plain = plain if "weight" in plain.columns else plain.withColumn("weight", F.lit(1.0))
    normed = norm_edges(plain.select(*keys, "src", "dst", "weight"), keys)
    if terms > 2:
        normed = materialise(normed, "edges")
    older = nodes.select(*keys, pos, *cols)
    all_terms = [older.withColumn("term", F.lit(0))]
    current = None
    for k in range(1, terms):
        source = older if current is None else current
        step = hop(source, normed, keys, cols, pos)
        if current is None:
            nxt = step.select(*keys, pos, *[(-F.col(c)).alias(c) for c in cols])
        else:
            prev = older.select(*keys, pos, *[F.col(c).alias(f"__{c}") for c in cols])
            nxt = step.join(prev, [*keys, pos]).select(*keys, pos, *[(-2 * F.col(c) - F.col(f"__{c}")).alias(c) for c in cols])
            older = current
        if k + 1 < terms:
            nxt = materialise(nxt, "term")
        current = nxt
        all_terms.append(current.withColumn("term", F.lit(k)))
    out = all_terms[0]
    for t in all_terms[1:]:
        out = out.unionByName(t)
    return out


def channel_groups(nodes: DataFrame, edges: DataFrame, keys: list[str], groups: list[list[str]], pos: str = "pos") -> DataFrame:
    """Normalised neighbour sums per channel group, one array column per group.

    All groups share the adjacency, so one hop serves them together.
    """
    cols = [c for g in groups for c in g]
    summed = propagate(nodes, edges, keys, cols, [0.0, 1.0], pos)
    return summed.select(*keys, pos, *[F.array(*g).alias(f"group_{i}") for i, g in enumerate(groups)])


def sample_neighbours(seeds: DataFrame, edges: DataFrame, keys: list[str], fanout: list[int], *, seed: int = 42) -> DataFrame:
    """(seed, hop, src, dst): at most ``fanout[h]`` in-edges per vertex and hop, -1 for all.

    The rank filter is pushed below the shuffle by Spark, so a hub keeps ``fanout`` edges per task.
    """
    from pyspark.sql import Window as W

    frontier = seeds.select(*keys, F.col("pos").alias("seed"), F.col("pos").alias("node")).distinct()
    out = None
    for h, n in enumerate(fanout):
        drawn = edges.select(*keys, "src", "dst").distinct()
        if n >= 0:
            w = W.partitionBy(*keys, "dst").orderBy(digest([F.col("src"), F.col("dst")], seed + h), "src")
            drawn = drawn.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")
        step = frontier.join(drawn, (frontier["node"] == drawn["dst"]) & _same(frontier, drawn, keys))
        step = step.select(*[frontier[k] for k in keys], "seed", F.lit(h).alias("hop"), "src", "dst")
        out = step if out is None else out.unionByName(step)
        frontier = step.select(*keys, "seed", F.col("src").alias("node")).distinct()
    return out


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & (a[k] == b[k])
    return cond
