"""Queries on the sample graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.operators import graph
from sensorloom.plans import bindings as B
from sensorloom.plans.registry import query, with_ctes

FS = 0.01  # makes the phases fit the short test series
BOUNDS = graph.phase_bounds(FS)
KEYS = ["subject_id"]

_PHASE = "phase(phase, lo, hi) AS (VALUES " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in BOUNDS) + ")"
_EDGES = """fwd AS (SELECT subject_id, phase, pos AS src, pos + 1 AS dst FROM sig_pos JOIN phase ON pos >= lo AND pos < hi
                WHERE pos + 1 < least(hi, n)),
edges AS (SELECT subject_id, phase, src, dst FROM fwd UNION ALL SELECT subject_id, phase, dst, src FROM fwd)"""
_LOOPED = """looped AS (SELECT subject_id, src, dst FROM edges UNION ALL SELECT subject_id, pos, pos FROM sig_pos)"""
_NORM = """deg AS (SELECT subject_id, dst AS node, CAST(count(*) AS DOUBLE) AS degree FROM looped GROUP BY subject_id, dst),
normed AS (SELECT e.subject_id, e.src, e.dst, 1 / sqrt(a.degree) / sqrt(b.degree) AS norm FROM looped e
           JOIN deg a ON a.subject_id = e.subject_id AND a.node = e.src JOIN deg b ON b.subject_id = e.subject_id AND b.node = e.dst)"""
_HOPS = """x1 AS (SELECT n.subject_id, n.dst AS pos, sum(norm * x) AS x FROM normed n
       JOIN sig_pos s ON s.subject_id = n.subject_id AND s.pos = n.src GROUP BY n.subject_id, n.dst),
x2 AS (SELECT n.subject_id, n.dst AS pos, sum(norm * x) AS x FROM normed n
       JOIN x1 s ON s.subject_id = n.subject_id AND s.pos = n.src GROUP BY n.subject_id, n.dst)"""
BASE = [*B.SIG_CTES, _PHASE, _EDGES]


def nodes_and_edges(spark, sf_dir):
    nodes = B.sig_pos(spark, sf_dir).select("subject_id", "pos", "x", "label")
    return nodes, graph.phase_chain(nodes, BOUNDS, KEYS)


@query("gr_phase_chain", with_ctes(BASE, "SELECT subject_id, phase, src, dst FROM edges"))
def gr_phase_chain(spark, sf_dir):
    return nodes_and_edges(spark, sf_dir)[1]


@query("gr_degree", with_ctes([*BASE, _LOOPED], """
SELECT subject_id, dst AS node, CAST(count(*) AS DOUBLE) AS degree FROM looped GROUP BY subject_id, dst"""))
def gr_degree(spark, sf_dir):
    nodes, edges = nodes_and_edges(spark, sf_dir)
    return graph.degree(graph.add_self_loops(edges, nodes, KEYS), KEYS)


@query("gr_norm", with_ctes([*BASE, _LOOPED, _NORM], "SELECT subject_id, src, dst, round(norm, 6) AS norm FROM normed"))
def gr_norm(spark, sf_dir):
    nodes, edges = nodes_and_edges(spark, sf_dir)
    normed = graph.norm_edges(graph.add_self_loops(edges, nodes, KEYS), KEYS)
    return normed.withColumn("norm", F.round("norm", 6))


@query("gr_propagate", with_ctes([*BASE, _LOOPED, _NORM, _HOPS], """
SELECT s.subject_id, s.pos, round(s.x + 0.5 * x1.x + 0.25 * x2.x, 6) AS x
FROM sig_pos s JOIN x1 USING (subject_id, pos) JOIN x2 USING (subject_id, pos)"""))
def gr_propagate(spark, sf_dir):
    nodes, edges = nodes_and_edges(spark, sf_dir)
    return graph.propagate(nodes, edges, KEYS, ["x"], [1.0, 0.5, 0.25]).withColumn("x", F.round("x", 6))


_CHEB = """d AS (SELECT subject_id, dst AS node, count(*) AS degree FROM edges GROUP BY subject_id, dst),
cn AS (SELECT e.subject_id, e.src, e.dst, 1 / sqrt(a.degree) / sqrt(b.degree) AS norm FROM edges e
       JOIN d a ON a.subject_id = e.subject_id AND a.node = e.src JOIN d b ON b.subject_id = e.subject_id AND b.node = e.dst),
t1 AS (SELECT s.subject_id, s.pos, -coalesce(h.x, 0) AS x FROM sig_pos s LEFT JOIN
       (SELECT c.subject_id, c.dst AS pos, sum(norm * x) AS x FROM cn c JOIN sig_pos s ON s.subject_id = c.subject_id AND s.pos = c.src GROUP BY ALL) h
       USING (subject_id, pos)),
t2 AS (SELECT s.subject_id, s.pos, -2 * coalesce(h.x, 0) - s.x AS x FROM sig_pos s LEFT JOIN
       (SELECT c.subject_id, c.dst AS pos, sum(norm * x) AS x FROM cn c JOIN t1 s ON s.subject_id = c.subject_id AND s.pos = c.src GROUP BY ALL) h
       USING (subject_id, pos))"""


@query("gr_cheb_basis", with_ctes([*BASE, _CHEB], """
SELECT subject_id, pos, 0 AS term, x FROM sig_pos
UNION ALL SELECT subject_id, pos, 1, round(x, 6) + 0 FROM t1 UNION ALL SELECT subject_id, pos, 2, round(x, 6) + 0 FROM t2"""))
def gr_cheb_basis(spark, sf_dir):
    nodes, edges = nodes_and_edges(spark, sf_dir)
    return graph.chebyshev(nodes, edges, KEYS, ["x"]).withColumn("x", F.round("x", 6) + 0.0)


@query("gr_channel_gcn", with_ctes([*BASE, _LOOPED, _NORM, """h AS (
  SELECT n.subject_id, n.dst AS pos, sum(norm * x) AS a, sum(norm * label) AS b, sum(norm * x * label) AS c FROM normed n
  JOIN sig_pos s ON s.subject_id = n.subject_id AND s.pos = n.src GROUP BY n.subject_id, n.dst)"""], """
SELECT subject_id, pos, round(a, 6) AS g0_x, round(b, 6) AS g0_label, round(c, 6) AS g1_xl FROM h"""))
def gr_channel_gcn(spark, sf_dir):
    nodes, edges = nodes_and_edges(spark, sf_dir)
    wide = nodes.select("subject_id", "pos", "x", F.col("label").cast("double").alias("l"), (F.col("x") * F.col("label")).alias("xl"))
    out = graph.channel_groups(wide, edges, KEYS, [["x", "l"], ["xl"]])
    return out.select("subject_id", "pos", F.round(F.get("group_0", F.lit(0)), 6).alias("g0_x"),
                      F.round(F.get("group_0", F.lit(1)), 6).alias("g0_label"), F.round(F.get("group_1", F.lit(0)), 6).alias("g1_xl"))


_SAMPLE = """e AS (SELECT DISTINCT subject_id, src, dst FROM edges),
h0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, dst ORDER BY substr(md5(src || '|' || dst || '|42'), 1, 15), src) AS r FROM e) WHERE r <= 1),
h1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, dst ORDER BY substr(md5(src || '|' || dst || '|43'), 1, 15), src) AS r FROM e) WHERE r <= 10)"""


@query("gr_neighbor_sample", with_ctes([*BASE, _SAMPLE], """
SELECT subject_id, dst AS seed, 0 AS hop, src, dst FROM h0
UNION ALL SELECT a.subject_id, a.dst, 1, b.src, b.dst FROM h0 a JOIN h1 b ON a.subject_id = b.subject_id AND b.dst = a.src"""))
def gr_neighbor_sample(spark, sf_dir):
    """One neighbour in the first hop (a chain has two at most), up to ten in the second."""
    nodes, edges = nodes_and_edges(spark, sf_dir)
    return graph.sample_neighbours(nodes, edges, KEYS, [1, 10])
