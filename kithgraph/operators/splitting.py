"""Held-out edges, pairs that are no edges, and streams of edge events; all drawn by hashes of a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .egonet import adjacency
from .ranking import checkpointed, ranked


def _drawn(seed: int, *names: str) -> list:
    return [F.xxhash64(F.lit(seed), *names), *map(F.col, names)]


def spanning_forest(edges: DataFrame, seed: int = 42) -> DataFrame:
    """(src, dst): a spanning forest. Each component picks its least edge by hash to another one, until none is left."""
    held = checkpointed(edges.select("src", "dst", F.col("src").alias("a"), F.col("dst").alias("b")))
    forest = held.select("src", "dst").where("false")
    while not held.isEmpty():
        row = lambda x, y: F.struct(F.col(x).alias("comp"), F.xxhash64(F.lit(seed), "src", "dst").alias("h"), "src", "dst", F.col(y).alias("other"))
        least = held.select(F.inline(F.array(row("a", "b"), row("b", "a")))).groupBy("comp").agg(F.min(F.struct("h", "src", "dst", "other")).alias("e"))
        chosen = checkpointed(least.select("e.src", "e.dst", "comp", "e.other"))
        forest = forest.unionByName(chosen.select("src", "dst").distinct())
        joined = components(chosen.select(F.least("comp", "other").alias("src"), F.greatest("comp", "other").alias("dst")).distinct())
        for end in ("a", "b"):
            held = held.join(joined.select(F.col("node").alias(end), F.col("community").alias("_c")), end).drop(end).withColumnRenamed("_c", end)
        held = checkpointed(held.where("a <> b"))
    return checkpointed(forest)


def split_edges(edges: DataFrame, test_ratio: float = 0.15, max_test_edges: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test): a spanning forest stays in train; of the other edges the first by hash are held out, the ratio of all edges (half to even), at least one."""
    edges = checkpointed(edges.select("src", "dst"))
    target = max(1, round(edges.count() * test_ratio))
    if max_test_edges is not None:
        target = min(target, max_test_edges)
    rest = edges.join(spanning_forest(edges, seed), ["src", "dst"], "left_anti")
    test = checkpointed(ranked(rest, _drawn(seed, "src", "dst")).where(F.col("rank") < target).select("src", "dst"))
    return edges.join(test, ["src", "dst"], "left_anti"), test


def negative_pairs(edges: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """(src, dst): count different pairs of nodes that are no edges, or all such pairs if there are fewer."""
    nodes = checkpointed(ranked(adjacency(edges).select("node").distinct(), [F.col("node")], "at"))
    n, m = nodes.count(), edges.count()
    every = n * (n - 1) // 2
    spark = edges.sparkSession
    tries = 2 * count + 1000
    while True:
        if 4 * tries >= every:  # so few pairs that all of them are listed: pair i is the (i - x (x - 1) / 2)-th below x
            x = F.floor((1 + F.sqrt(1 + 8 * F.col("id").cast("double"))) / 2)
            drawn = spark.range(every).select(x.alias("j"), (F.col("id") - (x * (x - 1) / 2).cast("long")).alias("i"))
        else:
            place = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(n))
            drawn = spark.range(tries).select(place(0).alias("i"), place(1).alias("j")).where("i <> j")
        one, two = nodes.select(F.col("at").alias("i"), F.col("node").alias("x")), nodes.select(F.col("at").alias("j"), F.col("node").alias("y"))
        pairs = drawn.join(one, "i").join(two, "j").select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).distinct()
        free = checkpointed(pairs.join(edges, ["src", "dst"], "left_anti"))
        if 4 * tries >= every or free.count() >= min(count, every - m):
            return ranked(free, _drawn(seed, "src", "dst")).where(F.col("rank") < count).select("src", "dst")
        tries *= 4


def event_stream(edges: DataFrame, batches: int, batch_size: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(initial edges, events (batch, seq, action, src, dst)): in each batch batch_size edges that initial lacks are added and as many of its own removed, in the order of a hash."""
    total = batches * batch_size
    edges = checkpointed(edges.select("src", "dst"))
    added = checkpointed(ranked(edges, _drawn(seed, "src", "dst")).where(F.col("rank") < total))
    initial = checkpointed(edges.join(added, ["src", "dst"], "left_anti"))
    removed = ranked(initial, _drawn(seed + 1, "src", "dst")).where(F.col("rank") < total)
    both = added.withColumn("action", F.lit("add")).unionByName(removed.withColumn("action", F.lit("remove")))
    seq = F.xxhash64(F.lit(seed), "action", "src", "dst")
    return initial, both.select(F.floor(F.col("rank") / batch_size).alias("batch"), seq.alias("seq"), "action", "src", "dst")
