"""Maintained scores, construction by triples, run statistics and warm starts on graphs with known values."""

from itertools import combinations

import pytest

from kithgraph.operators import clusters, egonet, features, triples
from kithgraph.streaming import incremental
from kithgraph.streaming.miner import Miner, State, maintain_scores

PAIRS = sorted({(min(a, b), max(a, b)) for i in range(30) for a, b in [(i, (i * 7 + 3) % 30), (i, (i + 1) % 30), (i, (i + 2) % 30), (i % 5, i)] if a != b})
EVENTS = [(1, "remove", 0, 5), (2, "add", 29, 3), (3, "add", 3, 3), (4, "remove", 1, 2), (5, "add", 2, 1), (6, "add", 40, 0), (7, "add", 40, 1), (8, "remove", 6, 7), (9, "add", 2, 3)]


def graph(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def events_of(spark, rows=EVENTS):
    return spark.createDataFrame(rows, "seq int, action string, src long, dst long")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def after_events():
    edges = set(PAIRS)
    for _, action, a, b in EVENTS:
        if a != b:
            (edges.add if action == "add" else edges.discard)((min(a, b), max(a, b)))
    return sorted(edges)


@pytest.mark.parametrize("how", ["cc", "apm"])
def test_maintained_scores_equal_a_rebuild(spark, how):
    keeper = Miner(how, reuse_labels=False, min_score=2)
    state, stats = keeper.apply(keeper.initialize(graph(spark, PAIRS)), events_of(spark))
    fresh = keeper.initialize(graph(spark, after_events()))
    assert rows(state.edges) == after_events()
    assert rows(state.ego_edges) == rows(fresh.ego_edges) and rows(state.members) == rows(fresh.members)
    assert rows(state.scores) == rows(fresh.scores) and state.scores.count() > 0
    assert rows(keeper.partition(state)) == rows(keeper.rebuilt(state))
    assert stats["affected_egos"] > 0 and stats["ego_edge_updates"] > 0 and stats["score_delta_pairs"] > 0


def test_events_are_validated(spark):
    e = graph(spark, PAIRS)
    for bad in ([(1, "drop", 0, 1)], [(1, None, 0, 1)], [(1, "remove", 50, 51)], [(1, "remove", 0, 1), (2, "remove", 1, 0)]):
        with pytest.raises(ValueError):
            incremental.validated(e, events_of(spark, bad))
    fine = [(1, "add", 50, 51), (2, "remove", 51, 50), (3, "add", 0, 1), (4, "drop", 9, 9)]
    assert incremental.validated(e, events_of(spark, fine)).count() == 3


def test_scores_of_a_stream(spark, tmp_path):
    keeper = Miner("apm")
    keeper.initialize(graph(spark, PAIRS)).save(str(tmp_path / "state/version=0"))
    events_of(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq int, action string, src long, dst long").parquet(str(tmp_path / "in"))
    maintain_scores(stream, keeper, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination(90)
    got = State.load(spark, str(tmp_path / "state/version=1"))
    assert rows(got.edges) == after_events() and rows(got.ego_edges) == rows(egonet.ego_edges(graph(spark, after_events())))


def test_old_labels_start_together(spark):
    near = egonet.ego_edges(graph(spark, PAIRS))
    held = clusters.cluster(near, "apm", max_iter=0, start=clusters.cluster(near, "cc"))
    assert rows(held) == rows(clusters.cluster(near, "cc"))
    alone = clusters.cluster(near, "apm", max_iter=0)
    assert all(r.node == r.cluster for r in alone.collect())


@pytest.mark.parametrize("rho", [3, 5])
def test_triples_find_all_triangles(spark, rho):
    e = graph(spark, PAIRS)
    assert rows(triples.ego_edges_by_triples(e, rho)) == rows(egonet.ego_edges(e))
    parts = {r.node: r.p for r in egonet.degrees(e).select("node", triples.part_of("node", rho).alias("p")).collect()}
    want = sorted((*t, a, b) for t in combinations(range(rho), 3) for a, b in PAIRS if parts[a] in t and parts[b] in t)
    got = triples.triple_edges(e, rho)
    assert sorted((*r[:3], min(r[3:]), max(r[3:])) for r in got.collect()) == want
    r = triples.replication(e, rho).first()
    assert (r.input_edges, r.replicated_edges) == (len(PAIRS), len(want)) and r.replication_factor == pytest.approx(len(want) / len(PAIRS))
    assert triples.replication(e.where("false"), rho).first().replication_factor == 0
    with pytest.raises(ValueError):
        triples.triple_edges(e, 2)


def test_zero_scores_and_statistics_of_no_cluster(spark):
    scores = spark.createDataFrame([(1, 2, 0.0, 0.0), (1, 3, 1.0, 0.0)], "src long, dst long, w1 double, w3 double")
    assert [tuple(r) for r in features.non_zero(scores).collect()] == [(1, 3, 1.0, None)]
    near = egonet.ego_edges(graph(spark, PAIRS))
    empty = clusters.run_stats(clusters.cluster_stats(near, clusters.cluster(near), 99)).first()
    assert set(empty) == {0}
    whole = clusters.describe(graph(spark, [(1, 2), (2, 3), (1, 3), (3, 4)]), spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4), (2, 3), (2, 1)], "community long, node long")).first()
    assert whole.ego_cluster_count == 2 and whole.ego_cluster_mean_size == 3 and whole.ego_cluster_mean_density == pytest.approx((1 + 2 / 3) / 2)
