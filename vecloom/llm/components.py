"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links(a, b)``; the component is its least node.

    Rounds of two steps: every node's larger neighbours are hung on its least neighbour,
    then its smaller ones are. Edges never grow in number, no step gathers the neighbours
    of a node in one place (only their least, combined before the shuffle), and the number
    of rounds follows the logarithm of the longest path. Each round is written to the
    shared folder.
    """
    edges = links.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).filter("u <> v")
    edges = materialise(edges.distinct(), "edges")
    before = None
    while True:
        edges = materialise(_hang(_hang(edges, large=True), large=False), "edges")
        # The state of a round: what no longer changes is a forest of stars.
        state = edges.agg(
            F.count("*").alias("n"),
            F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h"),
        ).first()
        if state == before:
            break
        before = state
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)


def _hang(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v), u > v: hang neighbours on the least one of each node."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        hung = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return hung.filter("u <> v").distinct()
