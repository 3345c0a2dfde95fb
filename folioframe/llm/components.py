"""Connected components of an edge table by alternating stars; nothing is gathered on the driver or in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scratch


def _towards_least(edges: DataFrame, seen: DataFrame) -> DataFrame:
    """Each node of `seen` (u, v) gets the least of its neighbours and itself; a hub's rows are summed before the shuffle."""
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("hub"), F.least("u", "m").alias("m"))
    least = _scratch.materialise(least, "least")  # so that the join reads two plain shuffles and a hub can be split
    return edges.join(least, edges["u"] == least["hub"]).select("u", "v", "m")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with an edge; root is the component's least node.

    Large stars hang each node's larger neighbours on its least one, small stars its smaller ones; the components stay
    what they are, and after a few rounds each is a star on its least node. Each round is written to the shared folder.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = _scratch.materialise(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_least(both, both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = _scratch.materialise(large, "large-stars")
        # Now u > v in every row: a node's smaller neighbours are its rows.
        starred = _towards_least(large, large)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = _scratch.materialise(small, "small-stars")
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before:
            break
        before = state
    root = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())
