"""Neighbourhood edges and scores kept up to date under batches of edge events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.egonet import adjacency, ego_edges


def validated(edges: DataFrame, events: DataFrame) -> DataFrame:
    """events without loops, if each is an addition, or the removal of an edge that is there when it comes; else ValueError."""
    pair = events.where("src <> dst").select("seq", "action", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    unknown = pair.where("action IS NULL OR action NOT IN ('add', 'remove')").select("action").head(1)
    if unknown:
        raise ValueError(f"unknown action {unknown[0][0]!r}")
    turn = pair.withColumn("_last", F.lag("action").over(Window.partitionBy("src", "dst").orderBy("seq")))
    again = turn.where("action = 'remove' AND _last = 'remove'").select("src", "dst")
    absent = turn.where("action = 'remove' AND _last IS NULL").select("src", "dst").join(edges, ["src", "dst"], "left_anti")
    missing = again.unionByName(absent).head(1)
    if missing:
        raise ValueError(f"removal of an edge that is not there: {tuple(missing[0])}")
    return pair


def net_events(events: DataFrame) -> DataFrame:
    """The last event of each pair in a batch of (seq, action, src, dst); loops go."""
    pair = events.where("src <> dst").select("seq", "action", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return pair.groupBy("src", "dst").agg(F.max_by("action", "seq").alias("action"))


def apply_events(edges: DataFrame, events: DataFrame) -> DataFrame:
    """The edges after a batch."""
    last = net_events(events)
    kept = edges.join(last.where("action = 'remove'"), ["src", "dst"], "left_anti")
    return kept.unionByName(last.where("action = 'add'").select("src", "dst")).distinct()


def affected(before: DataFrame, after: DataFrame, events: DataFrame) -> DataFrame:
    """(node): ends of changed edges and the common neighbours of both ends, before or after; no other neighbourhood changes."""
    last = net_events(events)
    near = adjacency(before.unionByName(after).distinct())
    common = last.join(near.select(F.col("node").alias("src"), F.col("nbr")), "src").join(near.select(F.col("node").alias("dst"), "nbr"), ["dst", "nbr"])
    return last.select(F.explode(F.array("src", "dst")).alias("node")).unionByName(common.select(F.col("nbr").alias("node"))).distinct()


def triangle_edges(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """(ego, src < dst): the ego edges of all triangles of edges that hold a changed one (src, dst)."""
    near = adjacency(edges)
    common = changed.join(near.select(F.col("node").alias("src"), "nbr"), "src").join(near.select(F.col("node").alias("dst"), "nbr"), ["dst", "nbr"])
    row = lambda e, a, b: F.struct(F.col(e).alias("ego"), F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
    return common.select(F.inline(F.array(row("src", "dst", "nbr"), row("dst", "src", "nbr"), row("nbr", "src", "dst")))).distinct()


def refresh(old: DataFrame, before: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, ego edges) after a batch; a triangle that comes or goes is one ego edge for each of its nodes, and no neighbourhood is listed."""
    last = net_events(events)
    after = apply_events(before, events)
    pair = ["src", "dst"]
    lost = triangle_edges(last.where("action = 'remove'").join(before, pair, "left_semi").select(*pair), before)
    found = triangle_edges(last.where("action = 'add'").join(before, pair, "left_anti").select(*pair), after)
    kept = old.join(lost, ["ego", *pair], "left_anti")
    return after, kept.unionByName(found.select(*kept.columns))


def maintain(stream: DataFrame, state_dir: str, checkpoint: str):
    """Start a streaming query that applies batches of (seq, action, src, dst) to the tables edges and ego_edges below state_dir.

    A batch writes version batch + 1 from version batch; a batch that is run again writes the same version."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        read = lambda name: spark.read.parquet(f"{state_dir}/{name}/version={number}")
        after, near = refresh(read("ego_edges"), read("edges"), validated(read("edges"), batch))
        after.write.mode("overwrite").parquet(f"{state_dir}/edges/version={number + 1}")
        near.write.mode("overwrite").parquet(f"{state_dir}/ego_edges/version={number + 1}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
