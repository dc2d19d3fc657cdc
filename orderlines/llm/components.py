"""Connected components of an edge table, by contraction in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlines.functions.storage import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of the edges (a, b); component is one of its nodes.

    Each round sends every node to the least node of its neighbourhood and replaces the ends of the
    edges; edges inside one node vanish. The first round goes by value, which settles stars around
    their least node; later ones by a hash that changes, so that long chains shrink by a constant
    factor. Minima merge before the shuffle, so a node with very many edges is no hot group. Every
    round is written, and what was sent where is composed at the end.
    """
    edges = materialize(edges.where("a != b").select("a", "b").distinct(), "edges")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = F.col("b") if not moves else F.xxhash64("b", F.lit(len(moves)))
        own = F.col("a") if not moves else F.xxhash64("a", F.lit(len(moves)))
        moved = (
            ends.groupBy("a")
            .agg(F.min(F.struct(rank.alias("rank"), "b")).alias("other"))
            .select(F.col("a").alias("node"), F.least(F.struct(own.alias("rank"), F.col("a").alias("b")), "other")["b"].alias("to"))
        )
        moved = materialize(moved, "moves")
        moves.append(moved)
        left = moved.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = moved.select(F.col("node").alias("b"), F.col("to").alias("y"))
        contracted = edges.join(left, "a").join(right, "b").where("x != y")
        edges = materialize(
            contracted.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges"
        )
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    result = moves[0].select("node", F.col("to").alias("component"))
    for moved in moves[1:]:
        step = moved.select(F.col("node").alias("component"), "to")
        result = result.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return result
