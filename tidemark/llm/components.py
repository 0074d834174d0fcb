"""Connected components of a link table by smallest-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import checkpointed


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component): the smallest node reachable by the undirected links ``x``-``y``; only linked nodes appear.

    Each round takes the smallest label among a node's neighbours (combined before the shuffle) and then the label of
    that label, so that the rounds grow with the logarithm of the longest chain.  Labels are written to the shared
    folder after each round.
    """
    both = checkpointed(links.select(F.col("x").alias("node"), F.col("y").alias("other"))
                        .union(links.select(F.col("y").alias("node"), F.col("x").alias("other"))).distinct())
    labels = checkpointed(both.groupBy("node").agg(F.min("other").alias("low"))
                          .select("node", F.least("node", "low").alias("component")))
    for _ in range(max_rounds):
        near = (both.join(labels.select(F.col("node").alias("other"), "component"), "other")
                .groupBy("node").agg(F.min("component").alias("near")))
        lower = labels.join(near, "node").select("node", F.least("component", "near").alias("low"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("further"))
        after = checkpointed(lower.join(jump, "low").select("node", F.least("low", "further").alias("component"), "old"))
        done = after.filter("component <> old").isEmpty()
        labels = after.select("node", "component")
        if done:
            return labels
    raise RuntimeError("components did not settle")
