"""Connected components of a graph of longs by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbscore.session import materialize

MAX_ROUNDS = 200


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``edges``: the smallest node that it reaches.

    Null ends and loops are left out, repeated and mirrored edges count once. Every round
    points all neighbours of a node to its smallest one, first the larger neighbours, then
    the smaller ones; on a graph of stars nothing changes any more. A minimum per node is a
    partial aggregate, so a node with very many neighbours is no hot group, and the join
    that brings it back has one row per node on one side, so adaptive execution can split
    the other. Every round is written to the shared folder, which also cuts the lineage.
    """
    now = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    now = now.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    # Always from the larger node to the smaller one.
    now = materialize(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _state(now)
    for _ in range(MAX_ROUNDS):
        now = materialize(_small_star(_large_star(now)), "edges")
        state = _state(now)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select("b", "b").distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("a").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node now point to the smallest of it and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    larger = edges.select(F.col("b").alias("a"), F.col("a").alias("v"))
    return larger.join(least, "a").where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours now point to the smallest of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
