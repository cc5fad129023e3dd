"""What the pipeline's stages leave on disk."""

import pytest

import corpus_pipeline
from kithgraph.llm import common


def test_decontamination_moves_no_texts_and_drops_its_words(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    window = " ".join(f"w{i}" for i in range(12))
    spark.createDataFrame([("b1", window)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, f"see {window} here"), (None, "nothing"), (1, None), (2, "w0 w1 w2")], "doc_id long, text string")
    left = corpus_pipeline.uncontaminated(spark, docs, str(tmp_path))
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert sorted(left.collect(), key=str) == sorted(docs.collect()[1:], key=str)
    assert sorted(p.name.rsplit("-", 1)[0] for p in (tmp_path / "shared").iterdir()) == ["contaminated", "keyed"]


LONG = " ".join(f"word{i}" for i in range(90))
ROWS = [(7, LONG, "a"), (7, LONG, "b"), (None, LONG, "c"), (None, "alone in the world", "d"), (9, LONG.replace("word0 ", "other "), "e"), (9, "see the leaked passage", "f"), (5, None, "g"), (6, "", "h")]


@pytest.mark.parametrize(("stage", "left", "tables"), [("without_copies", "adefg", {"kept"}), ("without_near_copies", "adfgh", {"kept"}), ("uncontaminated", "abcdegh", {"contaminated"})])
def test_stages_over_a_table_leave_no_texts_on_disk(spark, tmp_path, monkeypatch, stage, left, tables):
    """Rows of files are known by their places: no stage keeps a copy of the texts, or tables in proportion to them."""
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    spark.createDataFrame([("b", "leaked passage")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for at in range(0, len(ROWS), 3):
        spark.createDataFrame(ROWS[at : at + 3], "doc_id long, text string, _file string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = getattr(corpus_pipeline, stage)(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert "".join(sorted(r["_file"] for r in got.collect())) in (left, left.replace("a", "b") if "b" not in left else left)
    assert {p.name.rsplit("-", 1)[0] for p in (tmp_path / "shared").iterdir()} == tables


def test_places_are_unique_and_only_of_tables(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(1000).repartition(7).write.parquet(path)
    docs = spark.read.parquet(path)
    once, again = ({r.id: r.k for r in corpus_pipeline.by_place(d, "k").collect()} for d in (docs, spark.read.parquet(path)))
    assert once == again and sorted(once.values()) == list(range(1000))
    twice = corpus_pipeline.by_place(spark.read.parquet(path, path), "k")
    assert twice is None or len({r.k for r in twice.collect()}) == twice.count()
    assert corpus_pipeline.by_place(docs.unionAll(docs), "k") is None and corpus_pipeline.by_place(docs.limit(5), "k") is None
    docs.write.json(f"{tmp_path}/t.json")
    assert corpus_pipeline.by_place(spark.read.json(f"{tmp_path}/t.json"), "k") is None
    assert corpus_pipeline.by_place(spark.read.parquet(path).where("id < 0"), "k") is None


def test_a_run_leaves_its_last_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, mark string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", lambda s, d, _: d.where("doc_id > 5")), ("two", lambda s, d, _: d.where("doc_id > 6"))])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 4
    assert [p.name.rsplit("-", 1)[0] for p in (tmp_path / "shared").iterdir()] == ["stage-two"]
    assert spark.read.parquet(f"{tmp_path}/documents.parquet").count() == len(ROWS)
