"""Connected components of a graph given as edges, by alternating large and small stars.

A round joins every node to the smallest node it touches, first its larger neighbours, then its smaller ones, until
nothing changes; then every node hangs on the smallest node of its component. Only edges and nodes' minima are
shuffled, each round's edges are written to the shared folder, and the driver sees a count and a checksum.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v; large if both_ways, else small."""
    near = edges
    if both_ways:
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = near.groupBy("u").agg(F.min("v").alias("m"))
    lowest = lowest.select(F.col("u").alias("node"), F.least("u", "m").alias("m"))
    # The minimum of a node goes to its edges; a node with very many edges is split by the adaptive skew join.
    met = near.join(lowest, near.u == lowest.node)
    if both_ways:
        moved = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = lowest.select(F.col("node").alias("u"), F.col("m").alias("v"))
        moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(own)
    return moved.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame, written: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """node and root (its component's smallest node) for all nodes of edges (u, v), roots excepted.

    Nodes are numbers; loops, repeated edges and edges with a null end are passed over. `written` may put the rounds'
    tables into a folder of the caller's.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = written(ordered.where(F.col("u") > F.col("v")).distinct(), "edges")
    mark = None
    while True:
        current = written(_star(_star(current, True), False), "edges")
        # A sum of hashes that may wrap; equal for equal sets of edges.
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
