"""Tables of experiment results: columns, sinks, reading back, and summaries over seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the names of result columns, in the order in which they are written
KEYS = ["dataset", "algorithm", "clusterer", "feature"]
PARTITION = ["community_count", "mean_size", "modularity", "coverage", "mean_density", "mean_conductance"]
LINKS = ["auc", "average_precision"]
SHARES = [f"p{p}" for p in (10, 25, 50, 75, 90)]
EGO_MEANS = ["ego_cluster_count", "ego_cluster_mean_size", "ego_cluster_mean_density", "ego_cluster_mean_conductance"]
EGO_STATS = [*EGO_MEANS[:3], *(f"ego_cluster_density_{p}" for p in SHARES), EGO_MEANS[3], *(f"ego_cluster_conductance_{p}" for p in SHARES)]
CIRCLES = {"circle_available": "false", "circle_precision": None, "circle_recall": None, "circle_f1": None}
SETTINGS = ["seed", "split_seed", "negative_seed", "apm_seed", "apm_seed_strategy", "construction", "ego_workers", "test_ratio", "max_test_edges", "nodes", "edges", "train_edges", "heldout_edges", "negative_edges"]
STATIC = [*KEYS, *SETTINGS, "runtime_sec", *PARTITION, *LINKS, *EGO_STATS, *CIRCLES]
TOPK = ["dataset", "seed", "algorithm", "clusterer", "feature", "k", "evaluated_k", "precision", "recall"]
TRIPLES = [*KEYS, "nodes", "edges", "train_edges", "heldout_edges", "rho", "runtime_sec", *PARTITION, *LINKS, *EGO_MEANS]
TRIPLES += [f"spark_{x}" for x in ("input_edges", "replicated_edges", "replication_factor", "partition_triples", "ego_edges", "ego_count", "runtime_sec")]
DYNAMIC = ["dataset", "batch", "nodes", "edges", "events", "affected_egos", "ego_edge_updates", "score_delta_pairs", "init_runtime_sec", "dynamic_update_sec", "full_egonet_sec", "louvain_sec", "speedup_vs_full"]
DYNAMIC += [f"{how}_{what}" for what in ("modularity", "density", "conductance") for how in ("dynamic", "full", "louvain")] + ["score_edges"]
SUMMARY_METRICS = ["runtime_sec", *PARTITION[2:], *LINKS, *EGO_STATS, "circle_precision", "circle_recall", "circle_f1"]
TEXT = {*KEYS, "apm_seed_strategy", "construction", "circle_available"}


def table_of(spark: SparkSession, rows: list[dict], columns: list[str]) -> DataFrame:
    """One row per run, a few values each; what a run does not have is null."""
    schema = ", ".join(f"{c} {'string' if c in TEXT else 'double'}" for c in columns)
    value = lambda c, v: v if v is None or c in TEXT else float(v)
    return spark.createDataFrame([tuple(value(c, r.get(c)) for c in columns) for r in rows], schema)


def write_results(rows: DataFrame, path: str, columns: list[str]) -> None:
    rows.select(*columns).write.mode("overwrite").csv(path, header=True)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, as the files have them; null where a file has nothing."""
    return spark.read.csv(path, header=True)


def number(value: str | Column) -> Column:
    """A text as a number; null if it is none."""
    return F.expr(f"try_cast(`{value}` AS double)") if isinstance(value, str) else value.try_cast("double")


def shown(value: str | Column) -> Column:
    """A number with four decimals, or n/a."""
    found = number(value)
    return F.when(found.isNotNull(), F.format_string("%.4f", found)).otherwise("n/a")


def summary(rows: DataFrame, metrics: list[str] = SUMMARY_METRICS, keys: list[str] = KEYS) -> DataFrame:
    """(keys, metric, seeds, n, mean, std) over runs: missing values are left out, a metric that no run has gives no row.

    seeds are those of all runs of the group, ascending; std is the sample deviation, 0 for one run."""
    held = rows.select(*keys, F.col("seed").cast("double").cast("int").alias("_seed"), *(number(c).alias(c) for c in metrics))
    seeds = held.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_set("_seed")), lambda s: s.cast("string")), " ").alias("seeds"))
    long = held.unpivot([*keys, "_seed"], metrics, "metric", "value").where("value IS NOT NULL AND NOT isnan(value)")
    per = long.groupBy(*keys, "metric").agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
    return per.join(seeds, keys).select(*keys, "metric", "seeds", "n", "mean", "std")


def topk_summary(rows: DataFrame) -> DataFrame:
    """(dataset, algorithm, clusterer, feature, k, metric, seeds, n, mean, std) of precision and recall."""
    return summary(rows.withColumn("k", number("k")), ["precision", "recall"], [*KEYS, "k"])


def report(rows: DataFrame, metrics: list[str], keys: list[str]) -> DataFrame:
    """Means per group as text with four decimals, n/a where no run has the metric."""
    means = rows.groupBy(*keys).agg(*(F.avg(number(c)).alias(c) for c in metrics))
    return means.select(*keys, *(shown(F.col(c)).alias(c) for c in metrics))
