"""Distributed connected components by alternating large-star and small-star steps.

Every step replaces edges by edges to a smaller node of the same component, until each node points at the
smallest node that it can reach. A step is one aggregation (a minimum per node, combined before the
shuffle) and one join. The join's two sides are shuffled on their own, so that adaptive execution can
split a hub that holds a large share of the edges. Each round is written to the shared folder, and the round
before it removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, rekey, store


def _with_min(edges: DataFrame, kind: str) -> DataFrame:
    """Rows (u, v) with m: the smallest of u and all its v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(rekey(F.col("u"), kind).alias("k"), F.least("u", "m").alias("m"))
    return edges.join(least, edges["u"] == least["k"]).drop("k")


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge at most and no node that others point at has one."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("n")), F.struct(F.col("v").alias("node"), F.lit(0).alias("n")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("n").alias("n"), F.min("n").alias("least")).where("n > 1 OR (n = 1 AND least = 0)").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """One row (node, component) for each node of links (a, b), as store() gives them; component is the smallest node reached.

    Links with a null end, repeated links and links of a node with itself join nothing new; nodes that
    have only such links aren't returned.
    """
    kind = links.schema[a].dataType.simpleString()
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = store(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for turn in range(max_rounds + 1):
        if _settled(edges):
            break
        if turn == max_rounds:
            raise RuntimeError(f"no fixed point after {max_rounds} rounds")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both, kind).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_min(large, kind)
        # every neighbour, and the node itself, moves to the smallest neighbour
        moved = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        last, edges = edges, store(moved.select("e.u", "e.v").where("u <> v").distinct())
        drop(last)
    out = store(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    drop(edges)
    return out
