"""Ranks over a whole table without moving it to one task, and intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table written in spark.checkpoint.dir; in local mode in a folder of our own where that is unset.

    A table read back has the size of its files. DataFrame.checkpoint keeps the estimate of the plan instead, whose
    number of digits doubles with each round of joins."""
    spark = df.sparkSession
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark._kithgraph_tables = getattr(spark, "_kithgraph_tables", None) or "file://" + tempfile.mkdtemp(prefix="kithgraph-")
    path, schema = f"{found.rstrip('/')}/graph-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """checkpointed, after which the shuffle files that led to it go: Spark deletes them when the driver has no plan with them."""
    out = checkpointed(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with running sums in the given order, the row itself included.

    Rows are split by ranges of the order; what stands before a range is summed over ranges, of which
    there are as many as shuffle partitions, so no window holds more than one range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = checkpointed(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    totals = held.groupBy("_p").agg(*(F.sum(c).alias(f"_{k}") for k, c in sums.items()))
    up_to = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_p", *(F.coalesce(F.sum(f"_{k}").over(up_to), F.lit(0)).alias(f"_{k}") for k in sums))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = held.join(F.broadcast(base), "_p")
    return out.select(*df.columns, *((F.sum(c).over(inside) + F.col(f"_{k}")).alias(k) for k, c in sums.items()))


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with its rank from 0 in the order, which must have no ties."""
    return running(df, order, {name: F.lit(1)}).withColumn(name, F.col(name) - 1)
