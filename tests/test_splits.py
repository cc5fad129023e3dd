"""Splits, event streams, global communities and partition metrics on graphs with known values."""

from itertools import combinations

import pytest

from kithgraph.operators import components, evaluation, louvain, splitting


def graph(spark, pairs):
    return spark.createDataFrame(sorted({(min(p), max(p)) for p in pairs}), "src long, dst long")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


CLIQUES = [p for k in range(4) for p in combinations(range(10 * k, 10 * k + 6), 2)] + [(0, 10), (10, 20), (20, 30)]


def test_split_keeps_a_forest_and_negatives_are_no_edges(spark):
    e = graph(spark, CLIQUES)
    train, test = splitting.split_edges(e, 0.2, seed=3)
    assert test.count() == round(0.2 * len(CLIQUES)) and sorted(rows(train) + rows(test)) == rows(e)
    assert rows(components.components(train)) == rows(components.components(e))
    assert splitting.split_edges(e, 0.2, max_test_edges=4)[1].count() == 4
    few, every = rows(splitting.negative_pairs(e, 50)), rows(splitting.negative_pairs(e, 10**6))
    nodes = sorted({x for p in CLIQUES for x in p})
    assert every == sorted(set(combinations(nodes, 2)) - set(rows(e))) and len(few) == 50 and set(few) <= set(every)


def test_event_stream(spark):
    e = graph(spark, CLIQUES)
    initial, events = splitting.event_stream(e, 3, 4)
    got = events.collect()
    per = {(b, a): [r for r in got if (r.batch, r.action) == (b, a)] for b in range(3) for a in ("add", "remove")}
    assert [len(v) for v in per.values()] == [4] * 6
    added, removed = ({(r.src, r.dst) for r in got if r.action == a} for a in ("add", "remove"))
    assert set(rows(initial)) == set(rows(e)) - added and removed <= set(rows(initial)) and len(removed) == 12


def test_louvain_finds_planted_cliques(spark):
    nodes = spark.createDataFrame([(x,) for x in sorted({x for p in CLIQUES for x in p})] + [(99,)], "node long")
    got = dict(rows(louvain.louvain(graph(spark, CLIQUES), nodes)))
    assert got == {x: x - x % 10 for x in got if x != 99} | {99: 99}
    assert rows(louvain.louvain(graph(spark, CLIQUES).where("false"), nodes)) == sorted((r.node, r.node) for r in nodes.collect())


def test_partition_metrics_with_overlaps_and_uncovered_nodes(spark):
    e = graph(spark, [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (5, 6)])
    nodes = spark.createDataFrame([(x,) for x in range(1, 7)], "node long")
    part = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 3), (2, 4)], "community long, node long")
    got = evaluation.evaluate_partition(e, nodes, part).first()
    # first communities: 1, 2, 3 -> 1 and 4 -> 2; 5 and 6 are uncovered; degrees 2 2 3 2 2 1
    assert got.community_count == 2 and got.mean_size == 2.5
    assert got.coverage == pytest.approx((3 + 1) / 6)
    assert got.modularity == pytest.approx(3 / 6 - (49 + 4 + 4 + 1) / 144)
    assert got.mean_density == pytest.approx((1 + 1) / 2) and got.mean_conductance == pytest.approx((1 / 7 + 3 / 5) / 2)
    empty = evaluation.evaluate_partition(e.where("false"), nodes, part).first()
    assert (empty.modularity, empty.coverage, empty.mean_density, empty.mean_conductance) == (0, 0, 0, 0)
