"""Link prediction and partition quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .egonet import degrees
from .ranking import running


def link_metrics(labelled: DataFrame) -> DataFrame:
    """One row (auc, average_precision) for (score, label 0 or 1). Equal scores count half and enter precision together.

    The running sums go over distinct scores, not over pairs, and over ranges of scores at once."""
    groups = labelled.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    run = running(groups, [F.desc("score")], {"cp": F.col("p"), "cn": F.col("n")})
    wins = F.sum(F.col("n") * (F.col("cp") - F.col("p")) + 0.5 * F.col("n") * F.col("p"))
    auc = F.coalesce(F.try_divide(wins, F.sum("p") * F.sum("n")), F.lit(0.0))
    ap = F.coalesce(F.try_divide(F.sum(F.col("p") * F.col("cp") / (F.col("cp") + F.col("cn"))), F.sum("p")), F.lit(0.0))
    return run.agg(auc.alias("auc"), ap.alias("average_precision"))


def labelled_scores(scores: DataFrame, positives: DataFrame, negatives: DataFrame, feature: str = "score") -> DataFrame:
    """(src, dst, label, score) of the given pairs; a pair without a score has 0."""
    pair = lambda d, label: d.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.lit(label).alias("label"))
    asked = pair(positives, 1).unionByName(pair(negatives, 0))
    return asked.join(scores.select("src", "dst", F.col(feature).cast("double").alias("score")), ["src", "dst"], "left").fillna(0.0, ["score"])


def precision_recall_at(labelled: DataFrame, ks: list[int]) -> DataFrame:
    """(k, evaluated_k, precision, recall) of (src, dst, score, label) ranked by falling score, then pair. Only the largest k rows are ranked."""
    ks = sorted({int(k) for k in ks if k > 0})
    each = F.array(*map(F.lit, ks)) if ks else F.array().cast("array<int>")
    top = labelled.orderBy(F.desc("score"), "src", "dst").limit(max(ks, default=0))
    ranked = top.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("score"), "src", "dst")))
    hits = ranked.select(F.explode(F.filter(each, lambda k: k >= F.col("rn"))).alias("k"), F.lit(1).alias("one"), F.col("label").alias("hit"), F.lit(0).alias("all"))
    total = labelled.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("all")).select(F.explode(each).alias("k"), F.lit(0).alias("one"), F.lit(0).alias("hit"), "all")
    per = hits.unionByName(total).groupBy("k").agg(F.sum("one").alias("evaluated_k"), F.sum("hit").alias("_h"), F.sum("all").alias("_t")).where("evaluated_k > 0")
    return per.select("k", "evaluated_k", (F.col("_h") / F.col("evaluated_k")).alias("precision"), F.coalesce(F.try_divide(F.col("_h").cast("double"), F.col("_t")), F.lit(0.0)).alias("recall"))


def evaluate_partition(edges: DataFrame, nodes: DataFrame, communities: DataFrame) -> DataFrame:
    """One row (community_count, mean_size, modularity, coverage, mean_density, mean_conductance) for (community, node).

    Communities may overlap and leave nodes out. For modularity and coverage a node belongs to its smallest community;
    for modularity the others are alone, for coverage an edge between two of them is covered. Density and conductance
    are means over communities of two nodes at least; a community that is the whole graph has conductance 0. Without
    edges all shares are 0."""
    member = communities.select("community", "node").where("community IS NOT NULL AND node IS NOT NULL").distinct()
    size = member.groupBy("community").agg(F.count("*").alias("size"))
    own = member.groupBy("node").agg(F.min("community").alias("own"))
    degree = degrees(edges)
    side = lambda d, name, end: d.select(F.col("node").alias(end), F.col(name).alias(f"_{end}"))
    # every edge, with the first community of both ends; nulls are equal
    ends = edges.join(side(own, "own", "src"), "src", "left").join(side(own, "own", "dst"), "dst", "left")
    same = F.col("_src").eqNullSafe(F.col("_dst"))
    edge_rows = ends.select(F.lit(1.0).alias("m"), same.cast("double").alias("covered"), (same & F.col("_src").isNotNull()).cast("double").alias("within"))
    first = nodes.select("node").join(own, "node", "left").join(degree, "node", "left").fillna(0, ["degree"])
    volume = first.where("own IS NOT NULL").groupBy("own").agg(F.sum("degree").alias("d")).select("d").unionByName(first.where("own IS NULL").select(F.col("degree").alias("d")))
    square_rows = volume.select((F.col("d").cast("double") * F.col("d")).alias("square"))
    # every community by itself, overlaps included; one that holds all nodes cuts nothing, so its conductance is 0
    inner = edges.join(member.select(F.col("node").alias("src"), "community"), "src").join(member.select(F.col("node").alias("dst"), "community"), ["dst", "community"])
    inside = inner.groupBy("community").agg(F.count("*").alias("inside"))
    volumes = member.join(degree, "node").groupBy("community").agg(F.sum("degree").alias("volume"))
    per = size.join(inside, "community", "left").join(volumes, "community", "left").fillna(0, ["inside", "volume"])
    n = F.col("size").cast("double")
    density = F.when(F.col("size") >= 2, 2 * F.col("inside") / (n * (n - 1)))
    cut = F.when(F.col("size") >= 2, F.coalesce(F.try_divide((F.col("volume") - 2 * F.col("inside")).cast("double"), F.col("volume")), F.lit(0.0)))
    community_rows = per.select(n.alias("size"), density.alias("density"), cut.alias("conductance"))
    parts = [edge_rows, square_rows, community_rows]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    zero = F.lit(0.0)
    whole = rows.agg(
        F.count("size").alias("community_count"),
        F.coalesce(F.avg("size"), zero).alias("mean_size"),
        F.coalesce(F.sum("m"), zero).alias("m"),
        F.coalesce(F.sum("covered"), zero).alias("covered"),
        F.coalesce(F.sum("within"), zero).alias("within"),
        F.coalesce(F.sum("square"), zero).alias("square"),
        F.coalesce(F.avg("density"), zero).alias("mean_density"),
        F.coalesce(F.avg("conductance"), zero).alias("mean_conductance"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), zero)
    m = F.col("m")
    return whole.select("community_count", "mean_size", (share(F.col("within"), m) - share(F.col("square"), 4 * m * m)).alias("modularity"), share(F.col("covered"), m).alias("coverage"), "mean_density", "mean_conductance")


def partition_quality(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """One row (communities, coverage, modularity) for (node, community), as evaluate_partition has them."""
    nodes = degrees(edges).select("node")
    return evaluate_partition(edges, nodes, partition).select(F.col("community_count").alias("communities"), "coverage", "modularity")


def rollup(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, n, mean, std): over runs, missing values left out; the sample deviation, 0 for one run."""
    long = rows.unpivot(keys, metrics, "metric", "value").where("value is not null")
    return long.groupBy(*keys, "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
