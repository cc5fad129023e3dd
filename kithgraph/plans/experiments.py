"""Runs that compare neighbourhood scores with global communities, on held-out edges and under streams of events.

python -m kithgraph.plans.experiments static|triples|dynamic --edges FILE [--name NAME] --out FOLDER
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters, egonet, evaluation, features, louvain, splitting, triples
from ..operators.components import score_partition
from ..operators.ranking import checkpointed
from ..sources import results
from ..sources.edges import read_csv, read_snap
from ..streaming.miner import Miner

#: Negatives are drawn with a seed of their own.
NEGATIVE_SEED_OFFSET = 100


def timed(action: Callable):
    """(what action returns, seconds); the action must write or count, a plan alone takes no time."""
    began = time.perf_counter()
    out = action()
    return out, time.perf_counter() - began


def _split(edges: DataFrame, test_ratio: float, max_test_edges: int | None, seed: int):
    train, test = splitting.split_edges(edges, test_ratio, max_test_edges, seed)
    train, held = checkpointed(train), test.count()
    # drawn on the whole graph, so that no held-out edge is a negative
    negatives = checkpointed(splitting.negative_pairs(edges, held, seed + NEGATIVE_SEED_OFFSET))
    return train, test, negatives, {"edges": edges.count(), "train_edges": train.count(), "heldout_edges": held, "negative_edges": negatives.count()}


def _links(scores: DataFrame, test: DataFrame, negatives: DataFrame, feature: str, ks: list[int]) -> tuple[dict, list[dict]]:
    labelled = checkpointed(evaluation.labelled_scores(scores, test, negatives, feature))
    return evaluation.link_metrics(labelled).first().asDict(), [r.asDict() for r in evaluation.precision_recall_at(labelled, ks).collect()]


def static_run(edges: DataFrame, name: str, seed: int = 42, clusterers=("cc", "apm"), construction: str = "triangle", test_ratio: float = 0.15, max_test_edges: int | None = None, top_k=(10, 50, 100), min_size: int = 2, **apm) -> tuple[DataFrame, DataFrame]:
    """(result rows, rows of precision and recall at k): one per clusterer and feature, and one for global communities."""
    spark, edges = edges.sparkSession, checkpointed(edges)
    nodes = checkpointed(egonet.degrees(edges).select("node"))
    train, test, negatives, sizes = _split(edges, test_ratio, max_test_edges, seed)
    asked = test.unionByName(negatives)
    base = {"dataset": name, "seed": seed, "split_seed": seed, "negative_seed": seed + NEGATIVE_SEED_OFFSET, "apm_seed": seed, "apm_seed_strategy": "base_seed_plus_sorted_ego_offset", "construction": construction, "ego_workers": 0, "test_ratio": test_ratio, "max_test_edges": max_test_edges, "nodes": nodes.count(), **sizes, **results.CIRCLES}
    rows, at_k = [], []

    def add(scores, feature, found, took):
        metrics, points = _links(scores, test, negatives, feature, list(top_k))
        rows.append({**base, **found, **metrics, "runtime_sec": took})
        at_k.extend({**base, **found, **p} for p in points)

    for how in clusterers:

        def scored():
            near = checkpointed(egonet.ego_edges(train, construction))
            members = checkpointed(clusters.cluster(near, how, seed, nodes=nodes, **apm))
            stats = clusters.run_stats(clusters.cluster_stats(near, members, min_size)).first().asDict()
            return checkpointed(features.non_zero(features.pair_scores(train, near, members, asked, min_size=min_size))), stats

        (scores, stats), took = timed(scored)
        for f in features.FEATURES:
            add(scores, f.lower(), {"algorithm": f"EgoNet-{how.upper()}-{f}", "clusterer": how.upper(), "feature": f, **stats}, took)
    found, took = timed(lambda: checkpointed(louvain.louvain(train, nodes, seed)))
    quality = evaluation.evaluate_partition(train, nodes, found).first().asDict()
    scores = features.common_neighbor_scores(train, asked, found)
    add(scores, "score", {"algorithm": "Louvain", "clusterer": "global", "feature": "community_common_neighbors", **quality, **dict.fromkeys(results.EGO_STATS, 0)}, took)
    return results.table_of(spark, rows, results.STATIC), results.table_of(spark, at_k, results.TOPK)


def triples_run(edges: DataFrame, name: str, rho: int = 4, seed: int = 42, test_ratio: float = 0.15, max_test_edges: int | None = None, min_score: float = 1.0, **apm) -> DataFrame:
    """Result rows of neighbourhoods built by triples, one per feature, with the replication of edges."""
    spark, edges = edges.sparkSession, checkpointed(edges)
    nodes = checkpointed(egonet.degrees(edges).select("node"))
    train, test, negatives, sizes = _split(edges, test_ratio, max_test_edges, seed)

    def scored():
        scores, stats = triples.friendship_scores(train, rho, nodes=nodes, seed=seed, **apm)
        return checkpointed(scores), stats.first().asDict()

    (scores, stats), took = timed(scored)
    near = triples.ego_edges_by_triples(train, rho, seed).agg(F.count("*").alias("e"), F.count_distinct("ego").alias("n")).first()
    placed = triples.replication(train, rho, seed).first()
    quality = evaluation.evaluate_partition(train, nodes, score_partition(nodes, scores, "w1", min_score)).first().asDict()
    spark_part = {"spark_input_edges": placed.input_edges, "spark_replicated_edges": placed.replicated_edges, "spark_replication_factor": placed.replication_factor, "spark_partition_triples": placed.used_triples, "spark_ego_edges": near.e, "spark_ego_count": near.n, "spark_runtime_sec": took}
    rows = []
    for f in features.FEATURES:
        metrics, _ = _links(scores, test, negatives, f.lower(), [1])
        rows.append({"dataset": name, "algorithm": f"EgoNet-Spark-{f}", "clusterer": "APM", "feature": f, "nodes": nodes.count(), "rho": rho, "runtime_sec": took, **sizes, **quality, **metrics, **stats, **spark_part})
    return results.table_of(spark, rows, results.TRIPLES)


def dynamic_run(edges: DataFrame, name: str, batches: int = 3, batch_size: int = 50, seed: int = 42, miner: Miner | None = None) -> DataFrame:
    """One row per batch: the update, a rebuild and global communities, with seconds and quality of each."""
    spark, miner = edges.sparkSession, miner or Miner(seed=seed)
    initial, stream = splitting.event_stream(edges, batches, batch_size, seed)
    stream = checkpointed(stream)
    state, first = timed(lambda: miner.initialize(initial))
    rows = []
    for i in range(batches):
        events = stream.where(F.col("batch") == i).drop("batch")
        (state, changed), update = timed(lambda: miner.apply(state, events))  # noqa: B023
        anew, full = timed(lambda: checkpointed(miner.rebuilt(state)))  # noqa: B023
        other, took = timed(lambda: checkpointed(louvain.louvain(state.edges, state.nodes, seed)))  # noqa: B023
        row = {"dataset": name, "batch": i + 1, "nodes": state.nodes.count(), "edges": state.edges.count(), "events": events.count(), **changed, "score_edges": state.scores.count()}
        row |= {"init_runtime_sec": 0 if i else first, "dynamic_update_sec": update, "full_egonet_sec": full, "louvain_sec": took, "speedup_vs_full": full / update if update else 0}
        for how, part in (("dynamic", miner.partition(state)), ("full", anew), ("louvain", other)):
            q = evaluation.evaluate_partition(state.edges, state.nodes, part).first()
            row |= {f"{how}_modularity": q.modularity, f"{how}_density": q.mean_density, f"{how}_conductance": q.mean_conductance}
        rows.append(row)
    return results.table_of(spark, rows, results.DYNAMIC)


def main(argv: list[str] | None = None) -> None:
    ask = argparse.ArgumentParser(description=__doc__)
    ask.add_argument("kind", choices=["static", "triples", "dynamic"])
    ask.add_argument("--edges", required=True, help="CSV with the header source,target, or white-space separated pairs with --name as prefix")
    ask.add_argument("--name", default="graph")
    ask.add_argument("--out", required=True)
    ask.add_argument("--seeds", type=int, nargs="+", default=[42])
    ask.add_argument("--rho", type=int, default=4)
    ask.add_argument("--batches", type=int, default=3)
    ask.add_argument("--batch-size", type=int, default=50)
    given = ask.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    edges = checkpointed(read_csv(spark, given.edges) if ".csv" in given.edges else read_snap(spark, given.edges, given.name))
    if given.kind == "static":
        runs = [static_run(edges, given.name, s) for s in given.seeds]
        rows, at_k = (checkpointed(_all(x)) for x in zip(*runs, strict=True))
        results.write_results(rows, f"{given.out}/rows", results.STATIC)
        results.write_results(at_k, f"{given.out}/topk", results.TOPK)
        for what, found in (("summary", results.summary(rows)), ("topk_summary", results.topk_summary(at_k))):
            results.write_results(found, f"{given.out}/{what}", found.columns)
        results.report(rows, ["runtime_sec", "auc", "average_precision", "modularity"], results.KEYS[:2]).show(100, False)
    elif given.kind == "triples":
        rows = _all([triples_run(edges, given.name, given.rho, s) for s in given.seeds])
        results.write_results(rows, f"{given.out}/rows", results.TRIPLES)
        results.report(rows, ["runtime_sec", "auc", "average_precision", "spark_replication_factor"], results.KEYS[:2]).show(100, False)
    else:
        rows = _all([dynamic_run(edges, given.name, given.batches, given.batch_size, s) for s in given.seeds])
        results.write_results(rows, f"{given.out}/rows", results.DYNAMIC)
        results.report(rows, ["dynamic_update_sec", "full_egonet_sec", "louvain_sec", "speedup_vs_full"], ["dataset"]).show(100, False)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


if __name__ == "__main__":
    main()
