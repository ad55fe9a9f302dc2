"""Connected components by contraction, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of longs -> (node, root), root being one label per component of the linked nodes.

    Each round sends every node to the smallest of its neighbours (two pointer jumps), relabels the edges and drops those that
    became loops, so the edge list shrinks at least by half; nodes without links do not appear. An empty input gives an empty result.
    """
    edges = staged(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p"))
        up = near.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        step = staged(near.join(up, "p").select("u", F.col("pp").alias("p")), "step")
        if labels is None:
            labels = step.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            labels = staged(labels.join(step, labels["root"] == step["u"], "left").select("node", F.coalesce("p", "root").alias("root")), "labels")
        a, b = step.select(F.col("u").alias("a"), F.col("p").alias("pa")), step.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        edges = staged(edges.join(a, "a").join(b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
