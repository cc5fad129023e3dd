"""Pair scores and clusters kept up to date under batches of edge events.

The state is a set of tables. What a neighbourhood adds to the scores is not stored: it follows from its clusters and
the edges, and a pair of one neighbourhood becomes or ceases to be an edge only if that neighbourhood is affected.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters
from ..operators.components import score_partition
from ..operators.egonet import adjacency, ego_edges
from ..operators.ranking import checkpointed
from .incremental import affected, refresh, validated

TRIPLE = ["ego", "src", "dst"]


@dataclass(frozen=True)
class State:
    """nodes (node), edges (src < dst), ego_edges (ego, src < dst), members (ego, node, cluster), scores (src < dst, w1)."""

    nodes: DataFrame
    edges: DataFrame
    ego_edges: DataFrame
    members: DataFrame
    scores: DataFrame

    def save(self, path: str) -> None:
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "State":
        return cls(*(spark.read.parquet(f"{path}/{f.name}") for f in fields(cls)))


@dataclass(frozen=True)
class Miner:
    """Parameters of maintained scores. With reuse_labels label propagation starts from a neighbourhood's last clusters."""

    clusterer: str = "apm"
    alpha: float = 0.3
    beta: float = 0.01
    max_iter: int = 20
    min_size: int = 2
    min_score: float = 1.0
    seed: int = 42
    reuse_labels: bool = True

    def __post_init__(self) -> None:
        if self.clusterer not in ("cc", "apm"):
            raise ValueError(f"unknown clusterer {self.clusterer!r}")

    def _members(self, near: DataFrame, start: DataFrame | None = None) -> DataFrame:
        warm = start if self.reuse_labels and self.clusterer == "apm" else None
        return checkpointed(clusters.cluster(near, self.clusterer, self.seed, self.alpha, self.beta, self.max_iter, start=warm, seeds="hash"))

    def _pairs(self, members: DataFrame, edges: DataFrame) -> DataFrame:
        """(ego, src, dst): pairs of one cluster of min_size at least that are no edge."""
        size = members.groupBy("ego", "cluster").agg(F.count("*").alias("_n")).where(F.col("_n") >= self.min_size)
        held = members.join(size, ["ego", "cluster"]).select("ego", "cluster", "node")
        both = held.withColumnRenamed("node", "src").join(held.withColumnRenamed("node", "dst"), ["ego", "cluster"]).where("src < dst")
        return both.join(edges, ["src", "dst"], "left_anti").select(*TRIPLE)

    def initialize(self, edges: DataFrame, nodes: DataFrame | None = None) -> State:
        """The state of a whole graph; nodes without edges are known only if nodes has them."""
        edges = checkpointed(edges.select("src", "dst"))
        ends = adjacency(edges).select("node")
        every = checkpointed((ends if nodes is None else ends.unionByName(nodes.select("node"))).distinct())
        near = checkpointed(ego_edges(edges))
        members = self._members(near)
        scores = self._pairs(members, edges).groupBy("src", "dst").agg(F.count("*").cast("double").alias("w1"))
        return State(every, edges, near, members, checkpointed(scores))

    def apply(self, state: State, events: DataFrame) -> tuple[State, dict[str, int]]:
        """The state after a batch of (seq, action, src, dst), and what changed.

        Raises ValueError for unknown actions and for removals of edges that are not there. Only the last event of a
        pair counts: a pair that comes and goes within a batch affects no neighbourhood."""
        events = checkpointed(validated(state.edges, events))
        after, near = refresh(state.ego_edges, state.edges, events)
        after, near = checkpointed(after), checkpointed(near)
        hit = checkpointed(affected(state.edges, after, events))
        egos = hit.withColumnRenamed("node", "ego")
        mine = lambda df: df.join(egos, "ego", "left_semi")
        old, now = mine(state.members), mine(near)
        new = self._members(now, old)
        signed = lambda df, n: df.withColumn("d", F.lit(n))
        moved = signed(self._pairs(old, state.edges), -1.0).unionByName(signed(self._pairs(new, after), 1.0))
        delta = checkpointed(moved.groupBy(*TRIPLE).agg(F.sum("d").alias("d")).where("d <> 0"))
        summed = state.scores.unionByName(delta.select("src", "dst", F.col("d").alias("w1"))).groupBy("src", "dst").agg(F.sum("w1").alias("w1")).where("w1 > 0")
        members = state.members.join(egos, "ego", "left_anti").unionByName(new)
        nodes = state.nodes.unionByName(adjacency(after).select("node")).distinct()
        was = mine(state.ego_edges)
        changed = was.join(now, TRIPLE, "left_anti").unionByName(now.join(was, TRIPLE, "left_anti"))
        stats = {"affected_egos": hit.count(), "ego_edge_updates": changed.count(), "score_delta_pairs": delta.count()}
        return State(checkpointed(nodes), after, near, checkpointed(members), checkpointed(summed)), stats

    def partition(self, state: State) -> DataFrame:
        """(node, community) by the pairs that score min_score at least; all nodes have one."""
        return score_partition(state.nodes, state.scores, "w1", self.min_score)

    def rebuilt(self, state: State) -> DataFrame:
        """(node, community) of a state built anew from the edges, for comparison."""
        return self.partition(self.initialize(state.edges, state.nodes))


def maintain_scores(stream: DataFrame, miner: Miner, state_dir: str, checkpoint: str):
    """Start a streaming query that applies batches of events to the states below state_dir, of which version=0 must be there.

    A batch writes version batch + 1 from version batch; a batch that is run again writes the same version."""

    def apply(batch: DataFrame, number: int) -> None:
        new, _ = miner.apply(State.load(batch.sparkSession, f"{state_dir}/version={number}"), batch)
        new.save(f"{state_dir}/version={number + 1}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
