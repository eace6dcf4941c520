"""Distributed connected components by contraction.

Each round every node hooks onto its smallest neighbour, chains are shortened by
pointer jumping until all are stars, and the edges are renamed to the stars'
centres. Rounds and jumps grow with the logarithm of the graph, every step is a
join or an aggregation with partial sums, and no task holds a whole component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktake.llm.common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (src, dst), any orderable type -> (node, component): the smallest node of each component.

    Nulls and loops are ignored, direction and repeats don't matter; nodes
    without an edge to another node don't appear; no edges give no rows.
    """
    left = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst")
    left = materialise(left.distinct(), "edges")
    found: DataFrame | None = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        hooked = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("near"))
        parent = materialise(hooked.select("node", F.least("node", "near").alias("up")), "parents")
        while True:
            step = parent.join(parent.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left")
            jumped = materialise(step.select("node", F.coalesce("top", "up").alias("up"), (F.coalesce("top", "up") != F.col("up")).alias("moved")), "jumps")
            parent = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        if found is None:
            found = parent.select("node", F.col("up").alias("component"))
        else:
            found = found.join(parent.select(F.col("node").alias("component"), "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        found = materialise(found, "components")
        as_src = parent.select(F.col("node").alias("src"), F.col("up").alias("a"))
        as_dst = parent.select(F.col("node").alias("dst"), F.col("up").alias("b"))
        left = left.join(as_src, "src").join(as_dst, "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
        left = materialise(left.distinct(), "edges")
    if found is None:
        return left.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return found
