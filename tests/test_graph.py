"""Fixtures with known values, and every query against its SQL on the smallest tables."""

import gzip

import duckdb
import pytest

from kithgraph.operators import clusters, egonet, evaluation, features
from kithgraph.plans import catalog
from kithgraph.sources import edges as sources
from kithgraph.streaming import incremental

SF = "/root/testdata/sf0.001"
CC = "u-a u-b u-c u-d a-c b-c b-d"


def graph(spark, text):
    return sources.canonical(spark.createDataFrame([tuple(x.split("-")) for x in text.split()], "src string, dst string"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("text", [CC, "u-a u-b u-c a-b b-c x-y y-z z-x a-x"])
def test_constructions_agree(spark, text):
    e = graph(spark, text)
    assert rows(egonet.ego_edges(e)) == rows(egonet.ego_edges(e, "neighbor"))


def test_scores_of_the_fixture(spark):
    e = graph(spark, CC)
    z = egonet.ego_edges(e)
    m = clusters.cluster(z)
    full = {(r.src, r.dst): (r.w1, round(r.w2, 6), r.w3, round(r.w4, 6)) for r in features.pair_scores(e, z, m).collect()}
    assert full == {("a", "b"): (2, 1.166667, 2, 0.583333), ("a", "d"): (1, 0.5, 0, 0.25), ("c", "d"): (2, 1.166667, 2, 0.583333)}
    asked = spark.createDataFrame([("b", "a")], "src string, dst string")
    one = features.pair_scores(e, z, m, asked).collect()
    assert [(r.src, r.dst, r.w1, r.w3) for r in one] == [("a", "b", 2, 2)]


def test_precision_recall(spark):
    scored = spark.createDataFrame([("a", "c", 0.9, 0), ("a", "b", 0.8, 1), ("b", "d", 0.8, 0), ("c", "d", 0.1, 1)], "src string, dst string, score double, label int")
    assert rows(evaluation.precision_recall_at(scored, [1, 2, 10])) == [(1, 1, 0.0, 0.0), (2, 2, 0.5, 0.5), (10, 4, 0.5, 1.0)]


def test_apm_is_a_partition_of_whole_labels():
    pairs = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f")]
    got = clusters.apm_labels(pairs, 13)
    assert set(got) == set("abcdef") and all(v <= k and got[v] == v for k, v in got.items())
    assert got == clusters.apm_labels(list(reversed(pairs)), 13)


def test_incremental_equals_rebuild(spark):
    e = graph(spark, "u-a u-b u-c a-b b-c v-a v-b v-c")
    events = spark.createDataFrame([(1, "add", "v", "u"), (2, "remove", "a", "b")], "seq int, action string, src string, dst string")
    after, z = incremental.refresh(egonet.ego_edges(e), e, events)
    assert rows(z) == rows(egonet.ego_edges(after))


def test_stream(spark, tmp_path):
    e = graph(spark, "u-a u-b u-c a-b b-c v-a v-b v-c")
    e.write.parquet(str(tmp_path / "state/edges/version=0"))
    egonet.ego_edges(e).write.parquet(str(tmp_path / "state/ego_edges/version=0"))
    events = spark.createDataFrame([(1, "add", "v", "u"), (2, "remove", "a", "b")], "seq int, action string, src string, dst string")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    incremental.maintain(stream, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination(60)
    after = spark.read.parquet(str(tmp_path / "state/edges/version=1"))
    assert rows(after) == rows(incremental.apply_events(e, events))
    assert rows(spark.read.parquet(str(tmp_path / "state/ego_edges/version=1")).select("ego", "src", "dst")) == rows(egonet.ego_edges(after))


def test_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("source,target\n a ,b\nb,a\nc,c\n,d\n")
    assert rows(sources.read_csv(spark, str(tmp_path / "e.csv"))) == [("a", "b")]
    with gzip.open(tmp_path / "s.txt.gz", "wt") as f:
        f.write("# comment\n\n1 2 9\n2\t1\n3 3\n")
    assert rows(sources.read_snap(spark, str(tmp_path / "s.txt.gz"), "g")) == [("g_1", "g_2")]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS FROM '{SF}/lineitem.parquet'")
    want = db.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple(round(float(v), 5) if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else str(v) for v in r)
    assert sorted(key([r[c] for c in want.columns]) for r in got.collect()) == sorted(map(key, want.fetchall()))
    spark.catalog.clearCache()
