"""Shared helpers: written intermediate tables and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than these six; ``bytes.split()`` cuts at exactly the same ones.
SPACES = " \t\n\r\x0b\x0c"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster (or a test) names in ``spark.checkpoint.dir``. A local session without one gets a
    temporary folder; on a cluster that would scatter tables over its machines, so it is an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "pulseloom-shared")
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> str:
    """The path of ``df`` written as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    # What the write shuffled is not needed once the table is there.
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, None)
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(clean) if before is None else spark.conf.set(clean, before)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: lineage ends there, so a lost executor
    costs at most the tasks that were running, and nothing above recomputes it."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name))


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``stored`` wrote and nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u, v)`` by alternating large-star and small-star rounds, until they settle.

    Returns ``(node, component)`` for every node that is not the smallest of its component, with that smallest one.
    Nodes that are not there are their own component. Every round is two aggregations and two equi-joins whose sizes
    are those of the edges; a hub's edges are pre-aggregated for the minimum, and its join partition can be split.
    Nulls are left out.
    """
    spark = edges.sparkSession
    path = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark, kind = None, dict(edges.dtypes)["u"]
    while True:
        now = spark.read.schema(f"u {kind}, v {kind}").parquet(path)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = new
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        before, path = path, stored(small, "edges")
        discard(spark, before)
