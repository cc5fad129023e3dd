"""Neighbourhood graphs of all nodes at once.

Edges are oriented from the node of smaller (degree, id): no node then has more than
sqrt(2 * edges) outgoing ones, so hubs do not make long wedge lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import settled


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, nbr), each edge both ways."""
    ends = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("node"), F.col("src").alias("nbr")))
    return edges.select(F.inline(ends))


def degrees(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy("node").agg(F.count("*").alias("degree"))


def _ranked_edges(edges: DataFrame) -> DataFrame:
    """(tail, head, rank) with (degree, id) of tail below that of head; rank is the degree of head."""
    d = degrees(edges)
    a = d.select(F.col("node").alias("src"), F.col("degree").alias("_ds"))
    b = d.select(F.col("node").alias("dst"), F.col("degree").alias("_dd"))
    up = F.struct("_ds", "src") < F.struct("_dd", "dst")
    ways = [F.when(up, F.col(x)).otherwise(F.col(y)).alias(name) for x, y, name in (("src", "dst", "tail"), ("dst", "src", "head"), ("_dd", "_ds", "rank"))]
    return edges.join(a, "src").join(b, "dst").select(*ways)


def oriented(edges: DataFrame) -> DataFrame:
    """(tail, head) with (degree, id) of tail below that of head."""
    return _ranked_edges(edges).select("tail", "head")


def triangles(edges: DataFrame) -> DataFrame:
    """(a < b < c), each triangle once.

    A node's outgoing heads are one list, by (degree, id). Each head gets the part of the list after it and keeps
    what it points to itself, so that no pair of heads is a row of its own. The lists are written, without which the
    shuffles before them would stay on disk; ids that fit take four bytes in them."""
    kind = edges.schema["src"].dataType
    lists = _ranked_edges(edges).groupBy("tail").agg(F.array_sort(F.collect_list(F.struct("rank", "head"))).alias("_o"))
    lists = settled(lists.select("tail", F.col("_o.head").alias("heads")))
    if isinstance(kind, T.LongType):
        ends = lists.agg(F.min(F.least("tail", F.array_min("heads"))), F.max(F.greatest("tail", F.array_max("heads")))).first()
        if ends[0] is not None and ends[0] >= -(1 << 31) and ends[1] < 1 << 31:
            lists = lists.select(F.col("tail").cast("int").alias("tail"), F.col("heads").cast("array<int>").alias("heads"))
    spots = lists.where(F.size("heads") > 1).select("tail", "heads", F.posexplode("heads").alias("_i", "y")).where(F.col("_i") + 1 < F.size("heads"))
    after = spots.select(F.col("tail").alias("x"), "y", F.slice("heads", F.col("_i") + 2, F.size("heads")).alias("zs"))
    own = lists.select(F.col("tail").alias("y"), F.col("heads").alias("ys"))
    closed = after.join(own, "y").select("x", "y", F.explode(F.array_intersect("zs", "ys")).alias("z"))
    abc = F.array_sort(F.array("x", "y", "z"))
    return closed.select(*(abc[i].cast(kind).alias(k) for i, k in enumerate("abc")))


def ego_edges(edges: DataFrame, construction: str = "triangle") -> DataFrame:
    """(ego, src < dst): the edges among each node's neighbours. A triangle is one such edge for each of its nodes."""
    if construction == "triangle":
        row = lambda e, s, d: F.struct(F.col(e).alias("ego"), F.col(s).alias("src"), F.col(d).alias("dst"))
        return triangles(edges).select(F.inline(F.array(row("a", "b", "c"), row("b", "a", "c"), row("c", "a", "b"))))
    if construction == "neighbor":
        near = adjacency(edges)
        one = near.select(F.col("node").alias("ego"), F.col("nbr").alias("src"))
        two = near.select(F.col("node").alias("ego"), F.col("nbr").alias("dst"))
        return one.join(edges, "src").join(two, ["ego", "dst"], "left_semi").select("ego", "src", "dst")
    raise ValueError(f"unknown construction {construction!r}")


def partition_triples(edges: DataFrame, rho: int) -> DataFrame:
    """(p0 <= p1 <= p2, src, dst): each edge with every triple of node partitions that holds both its ends; ids are integers."""
    if rho < 3:
        raise ValueError("rho must be 3 at least")
    spark = edges.sparkSession
    p = spark.range(rho).select(F.col("id").cast("int").alias("p"))
    triples = p.select(F.col("p").alias("p0")).join(p.select(F.col("p").alias("p1")), F.col("p1") > F.col("p0")).join(p.select(F.col("p").alias("p2")), F.col("p2") > F.col("p1"))
    # rho * (rho - 1) * (rho - 2) / 6 rows, a parameter's size
    pairs = triples.select("*", F.explode(F.array("p0", "p1", "p2")).alias("ps")).select("*", F.explode(F.array("p0", "p1", "p2")).alias("pd"))
    placed = edges.withColumns({"ps": F.pmod("src", F.lit(rho)).cast("int"), "pd": F.pmod("dst", F.lit(rho)).cast("int")})
    return placed.join(F.broadcast(pairs), ["ps", "pd"]).select("p0", "p1", "p2", "src", "dst")
