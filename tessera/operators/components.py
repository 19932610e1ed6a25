"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step joins every edge with the least neighbour of its end, so work per round is linear in the edges
and rounds grow with the logarithm of the longest path. Least neighbours come from partial
aggregates, so a node with very many edges costs no single task; the join on it is one that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import Scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the least of u and its neighbours."""
    around = _both(edges)
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u, is tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str, dst: str, *, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of an edge; ``component`` is the least node reachable.

    Edges are undirected, of any orderable type; loops and repeats do no harm; edges with a null end are not used. A
    node whose only edge is a loop is a component by itself.
    """
    scratch = Scratch(edges.sparkSession, "components")
    plain = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    start = scratch.table(plain.distinct(), "start")
    now = start.where("u <> v")
    before = None
    for k in range(max_rounds):
        now = scratch.table(_small_star(_large_star(now)), f"round{k}")
        # stars only move to smaller nodes, so count and sum of hashes tell whether anything moved
        state = now.agg(F.count(F.lit(1)), F.expr("try_sum(cast(xxhash64(u, v) as decimal(38,0)))")).first()
        if k:
            scratch.drop(f"round{k - 1}")
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = _both(start).select(F.col("u").alias("node")).distinct()
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
