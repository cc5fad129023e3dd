"""Queries over the co-purchase graph, each with equal SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters, components, egonet, evaluation, features, louvain, splitting, triples
from ..operators.ranking import settled
from ..sources.edges import co_purchase
from ..streaming import incremental, miner


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return co_purchase(spark, d).persist()


def _clustered(spark: SparkSession, d: str, how: str = "cc"):
    e = _edges(spark, d)
    z = egonet.ego_edges(e).persist()
    return e, z, clusters.cluster(z, how, nodes=egonet.degrees(e) if how == "apm" else None).persist()


def _scores(spark: SparkSession, d: str) -> DataFrame:
    s = features.component_pair_scores(egonet.ego_edges(settled(co_purchase(spark, d))))
    return s.select("src", "dst", "w1", F.round("w2", 6).alias("w2"), "w3", F.round("w4", 6).alias("w4"))


def _held(e: DataFrame) -> DataFrame:
    return e.where("(src * 31 + dst * 17) % 10 = 0")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return _candidates_of(_edges(spark, d))


def _candidates_of(e: DataFrame) -> DataFrame:
    other = e.select("src", (F.col("dst") + 1).alias("dst")).join(e, ["src", "dst"], "left_anti")
    return _held(e).withColumn("label", F.lit(1)).unionByName(other.where("(src * 31 + dst * 17) % 10 = 0").distinct().withColumn("label", F.lit(0)))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    e, c = _edges(spark, d), _candidates(spark, d)
    train = e.join(_held(e), ["src", "dst"], "left_anti")
    s = features.common_neighbor_scores(train, c.select("src", "dst"))
    return c.join(s, ["src", "dst"]).withColumn("score", F.round("score", 9))


def _events(e: DataFrame) -> DataFrame:
    """Held-out edges come back, others go."""
    k = F.col("src") * 31 + F.col("dst") * 17
    return e.where(k % 20 < 2).select(k.alias("seq"), F.when(k % 20 == 0, "add").otherwise("remove").alias("action"), "src", "dst")


def _refreshed(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    before = e.where("(src * 31 + dst * 17) % 20 <> 0").persist()
    return incremental.refresh(egonet.ego_edges(before), before, _events(e))[1]


def friend_topk(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("src", "dst", "w1").orderBy(F.desc("w1"), "src", "dst").limit(20)


def _stats(spark, d):
    _, z, m = _clustered(spark, d)
    s = clusters.cluster_stats(z, m)
    return s.withColumns({k: F.round(k, 9) for k in ("density", "conductance")})


def _quantiles(spark, d):
    q = _stats(spark, d).agg(F.count("*").alias("clusters"), F.percentile("size", F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9)))).alias("q"))
    return q.select("clusters", *(F.col("q")[i].alias(f"size_p{p}") for i, p in enumerate((10, 25, 50, 75, 90))))


def _quality(spark, d):
    e = _edges(spark, d)
    part = egonet.degrees(e).select("node", (F.col("node") % 7).alias("community"))
    return evaluation.partition_quality(e, part).select("communities", F.round("coverage", 9).alias("coverage"), F.round("modularity", 9).alias("modularity"))


def _stat_rollup(spark, d):
    s = _stats(spark, d).select((F.col("ego") % 5).alias("bucket"), "density", "conductance")
    r = evaluation.rollup(s, ["bucket"], ["density", "conductance"])
    return r.select("bucket", "metric", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _score_partition(spark, d):
    return components.score_partition(egonet.degrees(_edges(spark, d)), _scores(spark, d).select("src", "dst", "w1"), min_score=6)


def _metrics(spark, d):
    """Of communities by node % 7, those of remainder 6 left out."""
    e = _edges(spark, d)
    nodes = egonet.degrees(e).select("node")
    part = nodes.where("node % 7 < 6").select((F.col("node") % 7).alias("community"), "node")
    m = evaluation.evaluate_partition(e, nodes, part)
    return m.select("community_count", *(F.round(c, 9).alias(c) for c in m.columns[1:]))


def _split(spark, d):
    """What a split and its negatives hold: sizes, whether train keeps the components, and negatives that are edges or loops."""
    e = _edges(spark, d)
    train, test = splitting.split_edges(e)
    none = splitting.negative_pairs(e, 500, seed=142)
    before, after = components.components(e), components.components(train).withColumnRenamed("community", "kept")
    moved = before.join(after, "node", "left").where("NOT (community <=> kept)").agg(F.count("*").alias("moved_nodes"))
    wrong = none.join(e, ["src", "dst"], "left").agg(F.count("*").alias("negatives"), F.count_distinct("src", "dst").alias("different"))
    taken = none.join(e, ["src", "dst"], "left_semi").unionByName(none.where("src >= dst")).agg(F.count("*").alias("wrong_negatives"))
    sizes = train.agg(F.count("*").alias("train_edges")).crossJoin(test.agg(F.count("*").alias("test_edges")))  # single rows
    return sizes.crossJoin(moved).crossJoin(wrong).crossJoin(taken)


def _scores_by_triples(spark, d):
    s, _ = triples.friendship_scores(_edges(spark, d), clusterer="cc")
    return s.select("src", "dst", "w1", F.round("w2", 6).alias("w2"), "w3", F.round("w4", 6).alias("w4"))


def _scores_of_candidates(spark, d):
    """Given pairs, adjacent ones too; a feature that is 0 has no score."""
    e = settled(co_purchase(spark, d))
    s = features.non_zero(features.component_pair_scores(egonet.ego_edges(e), _candidates_of(e).select("src", "dst")))
    return s.select("src", "dst", "w1", F.round("w2", 6).alias("w2"), "w3", F.round("w4", 6).alias("w4"))


def _louvain(spark, d):
    e = settled(co_purchase(spark, d))
    return louvain.louvain(e, egonet.degrees(e).select("node"))


def _run_stats(spark, d):
    s = clusters.run_stats(_stats(spark, d))
    return s.select("ego_cluster_count", *(F.round(c, 6).alias(c) for c in s.columns[1:]))


def _partition_pair_scores(spark, d):
    """Common neighbours, and 1 more in the communities by node % 7 of the training graph; nodes outside it are in none."""
    e, c = _edges(spark, d), _candidates(spark, d)
    train = e.join(_held(e), ["src", "dst"], "left_anti")
    part = egonet.degrees(train).select("node", (F.col("node") % 7).alias("community"))
    s = features.common_neighbor_scores(train, c.select("src", "dst"), part)
    return s.select("src", "dst", F.round(F.round("score", 9), 6).alias("score"))


def _maintained(spark, d) -> tuple[miner.Miner, miner.State]:
    e, keeper = _edges(spark, d), miner.Miner("cc", min_score=6)
    state = keeper.initialize(e.where("(src * 31 + dst * 17) % 20 <> 0"), egonet.degrees(e).select("node"))
    return keeper, keeper.apply(state, _events(e))[0]


def _dynamic_partition(spark, d):
    keeper, state = _maintained(spark, d)
    return keeper.partition(state)


def queries() -> dict:
    return {
        "edges_canonical": _edges,
        "node_degrees": lambda s, d: egonet.degrees(_edges(s, d)),
        "triangles": lambda s, d: egonet.triangles(_edges(s, d)),
        "ego_edges_triangle": lambda s, d: egonet.ego_edges(_edges(s, d)),
        "ego_edges_neighbor": lambda s, d: egonet.ego_edges(_edges(s, d), "neighbor"),
        "partition_triples": lambda s, d: egonet.partition_triples(_edges(s, d), 4),
        "ego_components": lambda s, d: _clustered(s, d)[2],
        "cluster_stats": _stats,
        "cluster_stat_quantiles": _quantiles,
        "cluster_stat_rollup": _stat_rollup,
        "friend_scores_full": _scores,
        "friend_topk": friend_topk,
        "score_partition": _score_partition,
        "common_neighbor_score": lambda s, d: _labelled(s, d).select("src", "dst", F.round("score", 6).alias("score")),
        "link_auc_ap": lambda s, d: evaluation.link_metrics(_labelled(s, d)).select(F.round("auc", 6).alias("auc"), F.round("average_precision", 6).alias("average_precision")),
        "precision_recall_at_k": lambda s, d: evaluation.precision_recall_at(_labelled(s, d), [1, 10, 100]).select("k", "evaluated_k", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall")),
        "partition_quality": _quality,
        "partition_metrics": _metrics,
        "split_contract": _split,
        "louvain_partition": _louvain,
        "dynamic_ego_edges": _refreshed,
        "dynamic_scores": lambda s, d: _maintained(s, d)[1].scores,
        "dynamic_partition": _dynamic_partition,
        "friend_scores_triples": _scores_by_triples,
        "friend_scores_candidates": _scores_of_candidates,
        "cluster_run_stats": _run_stats,
        "partition_pair_scores": _partition_pair_scores,
        "triple_replication": lambda s, d: triples.replication(_edges(s, d)),
        "apm_clusters": lambda s, d: _clustered(s, d, "apm")[2],
    }


def oracle_sql() -> dict[str, str]:
    e = """e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b USING (l_orderkey)
 WHERE a.l_partkey < b.l_partkey AND a.l_quantity >= 25 AND b.l_quantity >= 25)"""
    adj = "adj AS (SELECT src AS node, dst AS nbr FROM e UNION ALL SELECT dst, src FROM e)"
    tri = "t AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst)"
    ego = "z AS (SELECT a AS ego, b AS src, c AS dst FROM t UNION ALL SELECT b, a, c FROM t UNION ALL SELECT c, a, b FROM t)"
    cc = """za AS (SELECT ego, src AS u, dst AS v FROM z UNION ALL SELECT ego, dst, src FROM z),
l(ego, node, label) AS (SELECT DISTINCT ego, u, u FROM za UNION SELECT za.ego, za.v, l.label FROM l JOIN za ON za.ego = l.ego AND za.u = l.node WHERE l.label < za.v),
m AS (SELECT ego, node, min(label) AS cluster FROM l GROUP BY ALL)"""
    st = """zd AS (SELECT ego, u AS node, count(*) AS d FROM za GROUP BY ALL),
i AS (SELECT z.ego, m.cluster, z.src, z.dst FROM z JOIN m ON m.ego = z.ego AND m.node = z.src JOIN m n ON n.ego = z.ego AND n.node = z.dst AND n.cluster = m.cluster),
ic AS (SELECT ego, cluster, count(*) AS k FROM i GROUP BY ALL),
s AS (SELECT m.ego, m.cluster, count(*) AS size, any_value(ic.k) AS internal_edges, sum(zd.d)::BIGINT AS volume FROM m JOIN zd USING (ego, node) JOIN ic USING (ego, cluster) GROUP BY m.ego, m.cluster HAVING count(*) >= 2),
w AS (SELECT ego, count(*) AS whole FROM m GROUP BY ego),
st AS (SELECT ego, cluster, size, internal_edges, volume, round(2.0 * internal_edges / (size * (size - 1)), 9) AS density,
 round(CASE WHEN size = whole THEN 0.0 ELSE (volume - 2 * internal_edges) / volume::DOUBLE END, 9) AS conductance FROM s JOIN w USING (ego))"""
    sc = """ia AS (SELECT ego, cluster, src AS node, dst AS nbr FROM i UNION ALL SELECT ego, cluster, dst, src FROM i),
idg AS (SELECT ego, cluster, node, count(*) AS d FROM ia GROUP BY ALL),
cm AS (SELECT x.ego, x.cluster, x.node AS src, y.node AS dst, count(*) AS c FROM ia x JOIN ia y ON x.ego = y.ego AND x.cluster = y.cluster AND x.nbr = y.nbr AND x.node < y.node GROUP BY ALL),
sc AS (SELECT x.node AS src, y.node AS dst, count(*)::DOUBLE AS w1, round(sum(2.0 * s.internal_edges / (s.size * (s.size - 1))), 6) AS w2, sum(coalesce(cm.c, 0))::DOUBLE AS w3, round(sum(least(x.d, y.d) / s.size::DOUBLE), 6) AS w4
 FROM idg x JOIN idg y ON x.ego = y.ego AND x.cluster = y.cluster AND x.node < y.node JOIN s ON s.ego = x.ego AND s.cluster = x.cluster
 LEFT JOIN cm ON cm.ego = x.ego AND cm.cluster = x.cluster AND cm.src = x.node AND cm.dst = y.node WHERE NOT EXISTS (FROM e WHERE e.src = x.node AND e.dst = y.node) GROUP BY ALL)"""
    lab = """h AS (SELECT * FROM e WHERE (src * 31 + dst * 17) % 10 = 0), tr AS (SELECT * FROM e EXCEPT SELECT * FROM h),
cand AS (SELECT src, dst, 1 AS label FROM h UNION ALL SELECT DISTINCT src, dst + 1, 0 FROM e o WHERE (src * 31 + (dst + 1) * 17) % 10 = 0 AND NOT EXISTS (FROM e WHERE e.src = o.src AND e.dst = o.dst + 1)),
ta AS (SELECT src AS node, dst AS nbr FROM tr UNION ALL SELECT dst, src FROM tr), td AS (SELECT node, count(*) AS d FROM ta GROUP BY ALL),
co AS (SELECT c.src, c.dst, count(*) AS n FROM cand c JOIN ta x ON x.node = c.src JOIN ta y ON y.node = c.dst AND y.nbr = x.nbr GROUP BY ALL),
lb AS (SELECT c.src, c.dst, c.label, round(coalesce(co.n, 0) / sqrt(coalesce(p.d, 1) * coalesce(q.d, 1)), 9) AS score FROM cand c LEFT JOIN co USING (src, dst) LEFT JOIN td p ON p.node = c.src LEFT JOIN td q ON q.node = c.dst)"""
    asked = sc.replace("WHERE NOT EXISTS (FROM e WHERE e.src = x.node AND e.dst = y.node)", "JOIN cand ON cand.src = x.node AND cand.dst = y.node")
    part = """pe AS (SELECT src, dst FROM sc WHERE w1 >= 6), pa AS (SELECT src AS u, dst AS v FROM pe UNION ALL SELECT dst, src FROM pe),
pl(node, label) AS (SELECT DISTINCT u, u FROM pa UNION SELECT pa.v, pl.label FROM pl JOIN pa ON pa.u = pl.node WHERE pl.label < pa.v)"""
    of = lambda *parts, r="": f"WITH {r}" + ",\n".join(parts) + "\n"
    full = of(e, tri, ego, cc, st, sc, r="RECURSIVE ")
    stats = of(e, tri, ego, cc, st, r="RECURSIVE ")
    labelled = of(e, lab)
    later = e.replace("e AS", "e0 AS", 1) + ",\ne AS (SELECT * FROM e0 WHERE (src * 31 + dst * 17) % 20 <> 1)"
    return {
        "edges_canonical": of(e) + "SELECT * FROM e",
        "node_degrees": of(e, adj) + "SELECT node, count(*) AS degree FROM adj GROUP BY node",
        "triangles": of(e, tri) + "SELECT * FROM t",
        "ego_edges_triangle": of(e, tri, ego) + "SELECT * FROM z",
        "ego_edges_neighbor": of(e, adj) + "SELECT x.node AS ego, e.src, e.dst FROM e JOIN adj x ON x.nbr = e.src JOIN adj y ON y.nbr = e.dst AND y.node = x.node",
        "partition_triples": of(e) + "SELECT p0, p1, p2, src, dst FROM e, (SELECT a.i::INT AS p0, b.i::INT AS p1, c.i::INT AS p2 FROM range(4) a(i), range(4) b(i), range(4) c(i) WHERE a.i < b.i AND b.i < c.i) WHERE src % 4 IN (p0, p1, p2) AND dst % 4 IN (p0, p1, p2)",
        "ego_components": of(e, tri, ego, cc, r="RECURSIVE ") + "SELECT * FROM m",
        "cluster_stats": stats + "SELECT * FROM st",
        "cluster_stat_quantiles": stats + "SELECT count(*) AS clusters, " + ", ".join(f"quantile_cont(size, {p / 100}) AS size_p{p}" for p in (10, 25, 50, 75, 90)) + " FROM st",
        "cluster_stat_rollup": stats + ", u AS (SELECT ego % 5 AS bucket, 'density' AS metric, density AS v FROM st UNION ALL SELECT ego % 5, 'conductance', conductance FROM st) SELECT bucket, metric, count(*) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std FROM u GROUP BY ALL",
        "friend_scores_full": full + "SELECT * FROM sc",
        "friend_topk": full + "SELECT src, dst, w1 FROM sc ORDER BY w1 DESC, src, dst LIMIT 20",
        "score_partition": of(e, tri, ego, cc, st, sc, adj, part, r="RECURSIVE ") + "SELECT node, coalesce(min(label), node) AS community FROM (SELECT DISTINCT node FROM adj) LEFT JOIN pl USING (node) GROUP BY node",
        "common_neighbor_score": labelled + "SELECT src, dst, round(score, 6) AS score FROM lb",
        "link_auc_ap": labelled + ", g AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM lb GROUP BY score), r AS (SELECT p, n, sum(p) OVER o AS cp, sum(n) OVER o AS cn FROM g WINDOW o AS (ORDER BY score DESC)) SELECT round(sum(n * (cp - p) + 0.5 * n * p) / (sum(p) * sum(n)), 6) AS auc, round(sum(p * cp / (cp + cn)) / sum(p), 6) AS average_precision FROM r",
        "precision_recall_at_k": labelled + ", r AS (SELECT *, row_number() OVER (ORDER BY score DESC, src, dst) AS rn FROM lb) SELECT k::INT AS k, count(*) AS evaluated_k, round(sum(label) / count(*), 9) AS precision, round(sum(label) / (SELECT sum(label) FROM lb), 9) AS recall FROM r JOIN (VALUES (1), (10), (100)) v(k) ON rn <= k GROUP BY k",
        "partition_quality": of(e, adj) + ", p AS (SELECT node % 7 AS community, count(*) AS d, sum((nbr % 7 = node % 7)::INT) AS i FROM adj GROUP BY ALL) SELECT count(*) AS communities, round(sum(i) / sum(d), 9) AS coverage, round(sum(i) / sum(d) - sum(d::DOUBLE * d) / (sum(d)::DOUBLE * sum(d)), 9) AS modularity FROM p",
        "partition_metrics": of(e, adj) + """, n AS (SELECT node, node % 7 AS c, count(*) AS d FROM adj GROUP BY ALL), m AS (SELECT count(*)::DOUBLE AS m, sum((src % 7 = dst % 7)::INT) AS covered FROM e),
w AS (SELECT c, count(*) AS s, sum(d) AS v FROM n WHERE c < 6 GROUP BY c), i AS (SELECT src % 7 AS c, count(*) AS k FROM e WHERE src % 7 = dst % 7 GROUP BY ALL),
p AS (SELECT s, v, coalesce(k, 0) AS k FROM w LEFT JOIN i USING (c)), a AS (SELECT sum(d * d) AS q FROM n WHERE c = 6)
SELECT count(*) AS community_count, round(avg(s), 9) AS mean_size, round(sum(k) / any_value(m) - (sum(v::DOUBLE * v) + any_value(q)) / (4 * any_value(m) * any_value(m)), 9) AS modularity,
 round(any_value(covered) / any_value(m), 9) AS coverage, round(avg(2.0 * k / (s * (s - 1))), 9) AS mean_density, round(avg((v - 2 * k) / v::DOUBLE), 9) AS mean_conductance FROM p, m, a""",
        "split_contract": of(e) + ", t AS (SELECT count(*) AS m, greatest(1, round_even(count(*) * 0.15, 0))::BIGINT AS t FROM e) SELECT m - t AS train_edges, t AS test_edges, 0::BIGINT AS moved_nodes, 500::BIGINT AS negatives, 500::BIGINT AS different, 0::BIGINT AS wrong_negatives FROM t",
        "dynamic_ego_edges": of(later, tri, ego) + "SELECT * FROM z",
        "dynamic_scores": of(later, tri, ego, cc, st, sc, r="RECURSIVE ") + "SELECT src, dst, w1 FROM sc",
        "dynamic_partition": of(later, tri, ego, cc, st, sc, adj, part, r="RECURSIVE ") + "SELECT node, coalesce(min(label), node) AS community FROM (SELECT src AS node FROM e0 UNION SELECT dst FROM e0) LEFT JOIN pl USING (node) GROUP BY node",
        "friend_scores_triples": full + "SELECT * FROM sc",
        "friend_scores_candidates": of(e, tri, ego, cc, st, lab, asked, r="RECURSIVE ") + "SELECT src, dst, nullif(w1, 0) AS w1, nullif(w2, 0) AS w2, nullif(w3, 0) AS w3, nullif(w4, 0) AS w4 FROM sc",
        "cluster_run_stats": stats
        + "SELECT count(*) AS ego_cluster_count, "
        + ", ".join(f"round(avg({k}), 6) AS ego_cluster_mean_{k}" for k in ("size", "density", "conductance"))
        + "".join(f", round(quantile_cont({k}, {p / 100}), 6) AS ego_cluster_{k}_p{p}" for k in ("density", "conductance") for p in (10, 25, 50, 75, 90))
        + " FROM st",
        "partition_pair_scores": labelled
        + """SELECT lb.src, lb.dst, round(score + (CASE WHEN p.node IS NULL THEN NULL ELSE lb.src % 7 END IS NOT DISTINCT FROM CASE WHEN q.node IS NULL THEN NULL ELSE lb.dst % 7 END)::INT, 6) AS score
 FROM lb LEFT JOIN td p ON p.node = lb.src LEFT JOIN td q ON q.node = lb.dst""",
    }
