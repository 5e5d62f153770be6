"""Connected components of an edge table: alternating large-star / small-star.

Each round is two grouped aggregations and two joins; the number of rounds
is O(log^2 n).  Every round's edge table is checkpointed to the shared
checkpoint folder (lineage stays short, lost executors recompute one round
only).  The component id is the smallest node id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fingerprint(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"),
              F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF))).alias("s"),
              F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(2147483647))).alias("t")).collect()[0]
    return (r["n"], r["s"], r["t"])


def _large_star(e: DataFrame) -> DataFrame:
    """For each node u: m = min(N(u) + u); link every larger neighbour to m."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = both.groupBy("u").agg(F.min("v").alias("m"))
    m = m.select("u", F.least("u", "m").alias("m"))
    return (both.where(F.col("v") > F.col("u")).join(m, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """Edges point from larger to smaller (u > v).  For each node u: m = min of
    its smaller neighbours; link u and all of them to m."""
    m = e.groupBy("u").agg(F.min("v").alias("m"))
    j = e.join(m, "u")
    linked = j.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = m.select("u", F.col("m").alias("v"))
    return linked.union(own).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst",
                         max_rounds: int = 200) -> DataFrame:
    """``(node, component)`` for every node that has an edge; component = the
    smallest node id of its component.  Nodes without edges are their own
    component and are not listed."""
    e = (edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where(F.col("a") != F.col("b"))
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = e.checkpoint(eager=True)
    fp = _fingerprint(e)
    for _ in range(max_rounds):
        nxt = _small_star(_large_star(e)).checkpoint(eager=True)
        nfp = _fingerprint(nxt)
        e = nxt
        if nfp == fp:
            break
        fp = nfp
    else:
        raise RuntimeError("connected components did not converge")
    # converged: every edge is (node, root); a root appears only as v
    roots = e.groupBy("u").agg(F.min("v").alias("component"))
    nodes = roots.select(F.col("u").alias("node"), "component")
    top = e.select(F.col("v").alias("node")).distinct().join(nodes.select("node"), "node", "left_anti")
    return nodes.unionByName(top.select("node", F.col("node").alias("component")))
