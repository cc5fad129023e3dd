"""From raw documents to packed sequences, each stage written and read again.

Stages decide about rows, not about values of doc_id: rows with a null doc_id are documents like others, and rows that
share a doc_id are judged each. All columns of the input come through, whatever their names.
"""

from __future__ import annotations

import itertools

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from kithgraph.llm.common import cut, discard, fresh_name, table


def by_place(docs: DataFrame, key: str) -> DataFrame | None:
    """docs, if it is a table of files and no more, with a number per row: the rows of the files before its own, and its place there. Else None.

    Every read of the table gives a row the same number, so that nothing has to be written for it."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return None
    try:
        meta = docs.metadataColumn("_metadata")
        file, row = meta.getField("file_path"), meta.getField("row_index")
        files = docs.select(file.alias("file"), row.alias("row")).groupBy("file").agg(F.count("*").alias("n"), (F.max("row") + 1).alias("end")).orderBy("file").collect()
    except AnalysisException:  # not all formats number their rows
        return None
    if any(f.n != f.end for f in files):  # a file that is read twice
        return None
    starts = itertools.accumulate((f.n for f in files), initial=0)
    name, at = fresh_name(docs, "_file"), fresh_name(docs, "_place")
    known = docs.sparkSession.createDataFrame([(f.file, n) for f, n in zip(files, starts, strict=False)], f"`{name}` string, `{key}` long")
    held = docs.select("*", file.alias(name), row.alias(at)).join(F.broadcast(known), name)
    return held.withColumn(key, F.col(key) + F.col(at)).drop(name, at)


def keyed(docs: DataFrame) -> tuple[DataFrame, str, DataFrame]:
    """(docs with a key per row, the key's name, (doc_id, text) with the key as doc_id); what is no table of files is written once, so that the keys stay."""
    key = fresh_name(docs, "_key")
    held = by_place(docs, key)
    if held is None:
        held = cut(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    return held, key, held.select(F.col(key).alias("doc_id"), "text")


def first_rows(held: DataFrame, key: str, groups: DataFrame, name: str) -> DataFrame:
    """Of each group of (doc_id: a row's key, name) the row with the smallest doc_id; null is larger than all, ties go to the first row.

    The keys are written, and the tables that led to the groups go before texts are moved."""
    ids = held.select(F.col(key).alias("_row"), F.col("doc_id").alias("_id"))
    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_row"))
    first = ids.join(groups.select(F.col("doc_id").alias("_row"), F.col(name).alias("_group")), "_row").groupBy("_group").agg(F.min(order).alias("first"))
    kept = cut(first.select(F.col("first._row").alias(key)), "kept")
    discard(*groups._kithgraph_made)
    return kept


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality field scores at its threshold at least; the field is fitted on the labelled documents of sf_dir."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = fresh_name(docs, "score")
    return quality.score(docs, model, name).where(F.col(name) >= quality.THRESHOLD).select(docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, white space aside: that with the smallest doc_id. Null and empty texts are one text."""
    held, key, plain = keyed(docs)
    kept = first_rows(held, key, exact_dedup.exact_groups(plain), "keep_id")
    return held.join(kept, key, "left_semi").select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: that with the smallest doc_id. Texts without words are no copies."""
    held, key, plain = keyed(docs)
    kept = first_rows(held, key, near_dedup.near_groups(plain), "component_id")
    return held.join(kept, key, "left_semi").select(docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of the benchmark of sf_dir. The keys of those that do are written: a small table moves no texts, and the words go."""
    held, key, plain = keyed(docs)
    hits = decontaminate.hits(plain, table(spark, sf_dir, "benchmark"))
    found = cut(hits.where("contaminated").select(F.col("doc_id").alias(key)), "contaminated")
    discard(*hits._kithgraph_made)
    return held.join(found, key, "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their places in sequences; equal doc_ids are packed each."""
    return packing.pack_documents(docs)


STAGES = [("quality", good_documents), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("decontaminate", uncontaminated), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a table of its own, which the next stage reads and which then goes."""
    docs, spent = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*spent)
        spent = [docs]
    return docs
