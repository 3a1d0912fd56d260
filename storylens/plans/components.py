"""Connected components and greedy matching as rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import lookup_join
from .lineage import cut


def _state(edges: DataFrame) -> tuple:
    """Order-free fingerprint of an edge set (one row of three numbers)."""
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))
    ).first()
    return tuple(row)


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component) with the smallest id of each component.

    Alternates the large-star and small-star steps: every node points its neighbours to
    the smallest one it knows.  The number of rounds grows with the logarithm of the
    component size, and a node with very many neighbours is a salted lookup, not a group.
    """
    edges = cut(edges.select("a", "b").filter("a <> b").distinct())
    state = _state(edges)
    while True:
        # Steps add no nodes, and there are at most two per edge.
        nodes_bound = 2 * (state[0] or 0)
        edges = cut(_star(_star(edges, True, nodes_bound), False, nodes_bound))
        new_state = _state(edges)
        if new_state == state:
            break
        state = new_state
    members = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component"))
    found = members.unionByName(roots).groupBy("id").agg(F.min("component").alias("component"))
    if nodes is None:
        return found
    return nodes.select("id").join(found, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )


def _star(edges: DataFrame, large: bool, nodes_bound: int) -> DataFrame:
    """One step.  Edges come out as (a, b) with a > b."""
    high, low = F.greatest("a", "b"), F.least("a", "b")
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    else:
        both = edges.select(high.alias("u"), low.alias("v"))
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = lookup_join(both, smallest, "u", rows=nodes_bound)
    if large:
        moved = joined.filter(F.col("v") > F.col("u"))
        kept = moved.select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        kept = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            smallest.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return kept.filter("a <> b").distinct()


def greedy_matching(edges: DataFrame, score: str = "score") -> DataFrame:
    """Pairs chosen by descending score such that no node is used twice.

    Equals taking edges one by one in (score, a, b) order: in every round the edges that
    are the best of both their ends are taken and all edges touching them dropped.
    """
    remaining = cut(edges.select("a", "b", score))
    chosen = remaining.limit(0)
    while not remaining.isEmpty():
        order = F.struct((-F.col(score)).alias("s"), "a", "b")
        ends = remaining.select(F.col("a").alias("n"), order.alias("e")).unionByName(
            remaining.select(F.col("b").alias("n"), order.alias("e"))
        )
        best = ends.groupBy("n").agg(F.min("e").alias("e"))
        taken = cut(
            best.groupBy("e").agg(F.count(F.lit(1)).alias("ends")).filter("ends = 2")
            .select("e.a", "e.b", (-F.col("e.s")).alias(score))
        )
        used = taken.select(F.col("a").alias("n")).unionByName(taken.select(F.col("b").alias("n")))
        chosen = chosen.unionByName(taken)
        remaining = cut(
            remaining.join(used.withColumnRenamed("n", "a"), "a", "left_anti")
            .join(used.withColumnRenamed("n", "b"), "b", "left_anti")
            .select("a", "b", score)
        )
    return chosen
