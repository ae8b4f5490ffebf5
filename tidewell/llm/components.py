"""Connected components of a graph given by its edges, in rounds of joins that shrink the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.runtime import lean_stage as stage


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, component) for every vertex of ``edges`` (a, b): the smallest vertex that it reaches.

    Each round a vertex moves to the first vertex around it, in an order by digest, and from there once
    more; edges move with their ends, and those that become loops or equal are gone, so that each round
    works on what is left. As neighbours stay neighbours or meet, components stay what they are. A digest
    leaves no long chains of falling vertices, whatever the numbers are. Every round is written; it ends
    when no edge is left.
    """
    e = edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    e, moves = stage(e.distinct(), "edges"), []
    while not moves or e.limit(1).count():
        if len(moves) == rounds:
            raise RuntimeError(f"edges are left after {rounds} rounds")
        ends = e.select(F.col("a").alias("v"), F.col("b").alias("w")).union(e.select(F.col("b").alias("v"), F.col("a").alias("w")))
        order = lambda c: F.struct(F.xxhash64(c).alias("at"), F.col(c).alias("v"))
        near = ends.groupBy("v").agg(F.min(order("w")).alias("near")).select("v", F.least("near", order("v")).getField("v").alias("c"))
        move = stage(near.join(near.select(F.col("v").alias("c"), F.col("c").alias("to")), "c").select("v", F.col("to").alias("c")), "moves")
        moves.append(move)
        e = e.join(move.select(F.col("v").alias("a"), F.col("c").alias("x")), "a").join(move.select(F.col("v").alias("b"), F.col("c").alias("y")), "b")
        e = stage(e.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    found = moves.pop()
    while moves:
        later = found.select(F.col("v").alias("c"), F.col("c").alias("to"))
        found = moves.pop().join(later, "c", "left").select("v", F.coalesce("to", "c").alias("c"))
    found = stage(found, "found")
    return stage(found.join(found.groupBy("c").agg(F.min("v").alias("component")), "c").select("v", "component"), "components")
