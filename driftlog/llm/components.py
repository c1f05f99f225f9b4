"""Connected components by alternating star contraction, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.session import save_and_reload


def _larger_to_least(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the node's least neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.join(least, "u")
        .filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _smaller_to_least(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = (
        edges.join(least, "u")
        .filter(F.col("v") > F.col("m"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other at most, and on none that hangs."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(
        edges.select("v", F.lit(0), F.lit(1))
    )
    nodes = ends.groupBy("id").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return nodes.filter("hangs > 1 or (hangs = 1 and holds = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node with an edge; the component is the least id.

    ``edges`` holds two columns of ids.  Loops and NULL ends are ignored.  Only
    minima are ordered per node, so a node with very many edges is combined
    before the shuffle and its join side can be split; each pass is written to
    the shared folder, so its lineage is one table.  Edges always lead to a
    lesser id, so they are done as soon as they are stars, at once if the given
    ones are.
    """
    u, v = (F.col(c) for c in edges.columns[:2])
    now = edges.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    now = save_and_reload(now, "links")
    while not _are_stars(now):
        now = save_and_reload(_smaller_to_least(_larger_to_least(now)), "stars")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
