"""Components of a whole graph, and the partition that pair scores give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .egonet import adjacency
from .ranking import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, community) for nodes of edges, a community named by its smallest node.

    Each round takes the least label among neighbours, then the label of that label, so
    that long chains shorten by half."""
    near = checkpointed(adjacency(edges))
    now = checkpointed(near.groupBy("node").agg(F.least(F.min("nbr"), F.col("node")).alias("community")))
    while True:
        heard = near.join(now.select(F.col("node").alias("nbr"), F.col("community").alias("c")), "nbr").groupBy("node").agg(F.min("c").alias("c"))
        least = now.join(heard, "node").select("node", F.col("community").alias("old"), F.least("community", "c").alias("c"))
        jump = now.select(F.col("node").alias("c"), F.col("community").alias("far"))
        new = checkpointed(least.join(jump, "c").select("node", "old", F.least("c", "far").alias("community")))
        now = new.select("node", "community")
        if new.where("old <> community").isEmpty():
            return now


def score_partition(nodes: DataFrame, scores: DataFrame, feature: str = "w1", min_score: float = 1.0) -> DataFrame:
    """(node, community): components of the pairs that score min_score at least; nodes without such a pair are alone."""
    found = components(scores.where(F.col(feature) >= min_score).select("src", "dst"))
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("community", "node").alias("community"))
