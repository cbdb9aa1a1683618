"""Connected components of a table of edges, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partforge.llm.staging import staged


def turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("b").alias("a"), F.col("a").alias("b"))


def contracted(edges: DataFrame, larger: bool) -> DataFrame:
    """Link each node's larger (else its smaller) neighbours to the smallest of them and itself."""
    both = edges.unionByName(turned(edges)) if larger else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    linked = both.join(least, "a")
    if larger:
        return linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
    moved = linked.select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).where("a <> b").distinct()


def settled(edges: DataFrame) -> bool:
    """Whether each component is a star: every node but its smallest has one edge, to that."""
    ends = F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("down")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("down")),
    )
    met = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
    return met.where("down > 1 or (down = 1 and least = 0)").agg(F.count(F.lit(1))).first()[0] == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of `edges` (a, b), the label being the smallest node of its component.

    Each round halves the depth of the trees at least; only edges move, and every round is
    written, so that a lost executor repeats no more than one.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = staged(edges, "edges")
    while not settled(edges):
        edges = staged(contracted(contracted(edges, True), False), "edges")
    named = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return named.unionByName(roots)
