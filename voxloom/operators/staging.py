"""Written intermediate tables: they cut lineage and survive the loss of an executor."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir`` of the session; a local one only where none is set and the master is local."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    top = conf.rstrip("/") if conf else "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{top}/voxloom-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard_written(spark: SparkSession) -> None:
    """Delete all tables that this application has written; results that read them are of no more use."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def linked_sets(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node reachable.

    Each round makes every node's larger neighbours, then its smaller ones, point to the least node it
    knows; both are a minimum by key joined back. Rounds grow with the logarithm of the longest path.
    """
    size = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = size(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        outer = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "outer")
        low = outer.groupBy("a").agg(F.min("b").alias("m"))
        inner = outer.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = written(inner.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "inner")
        new = size(after)
        if new == mark:
            break
        now, mark = after, new
    leaf = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return leaf.unionByName(leaf.select(F.col("root").alias("node"), "root").distinct())
