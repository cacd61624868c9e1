"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hands its larger (large) or its not larger neighbours (small) to the smallest node it knows."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"), "n")
    least = materialize(least, "least")
    moved = hot_join(near, least, "u", "k", "n")  # a hub may hold a third of all links
    if large:
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return materialize(out.filter("u != v").distinct(), "edges")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link; root: the smallest node of its component.

    Every round is written to the shared folder. A round shuffles links only, with map-side minima for hub nodes; the
    number of rounds grows with the logarithm of the longest chain. Links to oneself and null ends are ignored.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    edges, before = materialize(edges, "edges"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        edges = _star(_star(edges, True), False)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
