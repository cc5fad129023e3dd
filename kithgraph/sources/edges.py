"""Edge lists: files in, files out, and projections of the test tables to graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CSV_SCHEMA = "source string, target string"


def canonical(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """Undirected simple edges as (src < dst), without loops or repetitions."""
    a, b = F.col(source), F.col(target)
    return edges.where(a != b).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with the header source,target: ids are trimmed, rows with an empty id dropped."""
    raw = spark.read.csv(path, schema=CSV_SCHEMA, header=True, enforceSchema=False)
    ids = raw.select(F.trim("source").alias("src"), F.trim("target").alias("dst"))
    return canonical(ids.where((F.length("src") > 0) & (F.length("dst") > 0)))


def write_csv(edges: DataFrame, path: str) -> None:
    edges.select(F.col("src").alias("source"), F.col("dst").alias("target")).orderBy("source", "target").write.csv(path, header=True)


def read_snap(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """White-space separated pairs, also gzipped; # starts a comment line; ids become prefix_id."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where((F.length(F.trim("value")) > 0) & ~F.trim("value").startswith("#"))
    pairs = lines.select(F.concat_ws("_", F.lit(prefix), parts[0]).alias("src"), F.concat_ws("_", F.lit(prefix), parts[1]).alias("dst"))
    return canonical(pairs)


def co_purchase(spark: SparkSession, sf_dir: str, min_quantity: float = 25) -> DataFrame:
    """Parts that one order has together, both in at least min_quantity."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col("l_quantity") >= min_quantity).select("l_orderkey", "l_partkey")
    other = lines.withColumnRenamed("l_partkey", "dst")
    both = lines.withColumnRenamed("l_partkey", "src").join(other, "l_orderkey").where("src < dst")
    return both.select("src", "dst").distinct()
