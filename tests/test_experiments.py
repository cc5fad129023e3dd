"""Result tables, summaries over seeds, and one run of each kind on a small graph."""

from itertools import combinations

import pytest

from kithgraph.plans import experiments
from kithgraph.sources import results
from kithgraph.streaming.miner import Miner

CLIQUES = [p for k in range(3) for p in combinations(range(10 * k, 10 * k + 6), 2)] + [(0, 10), (10, 20)]


@pytest.fixture()
def edges(spark):
    return spark.createDataFrame(CLIQUES, "src long, dst long")


def test_summary(spark, tmp_path):
    runs = [{"dataset": "g", "algorithm": "A", "clusterer": "cc", "feature": "W1", "seed": s, "auc": v} for s, v in ((43, 0.5), (42, 0.7), (44, None))]
    rows = results.table_of(spark, [*runs, {**runs[0], "algorithm": "B"}], results.STATIC)
    results.write_results(rows, str(tmp_path / "rows"), results.STATIC)
    back = results.read_results(spark, str(tmp_path / "rows"))
    assert back.columns == results.STATIC and {t for _, t in back.dtypes} == {"string"} and len(results.STATIC) == 45
    got = {(r.algorithm, r.metric): r for r in results.summary(back).collect()}
    assert set(got) == {("A", "auc"), ("B", "auc")}
    a = got["A", "auc"]
    assert (a.seeds, a.n) == ("42 43 44", 2) and a.mean == pytest.approx(0.6) and a.std == pytest.approx(0.1414213562)
    assert got["B", "auc"].std == 0
    shown = {r.algorithm: (r.auc, r.modularity) for r in results.report(back, ["auc", "modularity"], ["algorithm"]).collect()}
    assert shown == {"A": ("0.6000", "n/a"), "B": ("0.5000", "n/a")}
    assert len(results.TRIPLES) == 29 and len(results.DYNAMIC) == 23


def test_static_run(edges):
    rows, at_k = experiments.static_run(edges, "cliques", clusterers=("cc",), top_k=(1, 5))
    got = {r.algorithm: r for r in rows.collect()}
    assert set(got) == {f"EgoNet-CC-W{i}" for i in range(1, 5)} | {"Louvain"}
    one = got["EgoNet-CC-W1"]
    assert one.edges == len(CLIQUES) == one.train_edges + one.heldout_edges and one.negative_edges == one.heldout_edges == 7
    assert one.auc > 0.9 and one.ego_cluster_count > 0 and one.modularity is None
    assert got["Louvain"].auc > 0.9 and got["Louvain"].community_count == 3 and got["Louvain"].ego_cluster_count == 0
    assert at_k.count() == 10


def test_dynamic_run(edges):
    rows = experiments.dynamic_run(edges, "cliques", 2, 3, miner=Miner("cc")).collect()
    assert [(r.batch, r.events, r.edges) for r in rows] == [(1, 6, len(CLIQUES) - 6), (2, 6, len(CLIQUES) - 6)]
    for r in rows:
        assert (r.dynamic_modularity, r.dynamic_density, r.dynamic_conductance) == (r.full_modularity, r.full_density, r.full_conductance)


def test_triples_run(edges):
    rows = experiments.triples_run(edges, "cliques", rho=3).collect()
    assert [r.feature for r in rows] == ["W1", "W2", "W3", "W4"]
    # with three parts there is one triple, which holds every edge once
    assert all((r.spark_partition_triples, r.spark_replication_factor) == (1, 1) and 0 < r.spark_ego_count <= r.nodes for r in rows)
