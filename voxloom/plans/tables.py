"""Views of the star-schema tables as volumes, points, catalogues and logs; the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators.voxels import Grid

W = H = 25


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vox(spark: SparkSession, d: str) -> DataFrame:
    """Orders as one 25 x 25 x n volume, by order key."""
    i = F.col("o_orderkey")
    o = table(spark, d, "orders").select(
        F.lit(0).cast("long").alias("volume_id"),
        i.alias("i"),
        (i % W).alias("x"),
        (F.floor(i / W) % H).alias("y"),
        F.floor(i / (W * H)).alias("z"),
        (F.floor(F.col("o_totalprice") / 100) - 1000).alias("v"),
        (F.col("o_custkey") % 6).alias("label"),
    )
    return o


def grid(spark: SparkSession, d: str, sx=1.0, sy=1.0, sz=1.0) -> Grid:
    n = table(spark, d, "orders").agg(F.max("o_orderkey")).head()[0]
    return Grid(W, H, (n or 0) // (W * H) + 1, sx, sy, sz)


VOX = """vox AS (SELECT o_orderkey AS i, o_orderkey % 25 AS x, (o_orderkey // 25) % 25 AS y, o_orderkey // 625 AS z,
  CAST(floor(o_totalprice / 100) AS BIGINT) - 1000 AS v, o_custkey % 6 AS label FROM orders)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as points: volume_id (label), id, x, y, z."""
    e = lambda k: F.col("embedding")[k].cast("double") * 100
    return table(spark, d, "embeddings").select(F.col("label").cast("long").alias("volume_id"), F.col("vec_id").alias("id"), e(0).alias("x"), e(1).alias("y"), e(2).alias("z"))


PTS = """pts AS (SELECT CAST(label AS BIGINT) AS volume_id, vec_id AS id, CAST(embedding[1] AS DOUBLE) * 100 AS x,
  CAST(embedding[2] AS DOUBLE) * 100 AS y, CAST(embedding[3] AS DOUBLE) * 100 AS z FROM embeddings)"""


def objects(spark: SparkSession, d: str) -> DataFrame:
    """Parts as segmented objects with sizes, extents and centroids."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    return table(spark, d, "part").select(k.alias("id"), (k * 70).alias("voxels"), (s * 3).alias("ez"), (s * 2 + 5).alias("ey"), (s * 2 + 7).alias("ex"), (k % 320).alias("cz"), (k % 400).alias("cy"), (k % 600).alias("cx"))


OBJECTS = """objects AS (SELECT p_partkey AS id, p_partkey * 70 AS voxels, CAST(p_size AS BIGINT) * 3 AS ez, CAST(p_size AS BIGINT) * 2 + 5 AS ey,
  CAST(p_size AS BIGINT) * 2 + 7 AS ex, p_partkey % 320 AS cz, p_partkey % 400 AS cy, p_partkey % 600 AS cx FROM part)"""


def studies(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    gone = F.when(F.col("c_nationkey") % 4 == 0, F.lit(1).cast("long")).when(F.col("c_nationkey") % 4 == 1, F.lit(0).cast("long"))
    return table(spark, d, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("source"), (k * 1000 % 7919).alias("updated_at"), gone.alias("deleted_at"))


STUDIES = """studies AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS source, c_custkey * 1000 % 7919 AS updated_at,
  CASE WHEN c_nationkey % 4 = 0 THEN CAST(1 AS BIGINT) WHEN c_nationkey % 4 = 1 THEN CAST(0 AS BIGINT) END AS deleted_at FROM customer)"""


def presets(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_date(F.to_date("o_orderdate")).cast("long")
    gone = F.when(F.col("o_orderstatus") == "P", F.lit(1).cast("long"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("study_id"), at.alias("updated_at"), gone.alias("deleted_at"))


PRESETS = """presets AS (SELECT o_orderkey AS id, o_custkey AS study_id, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS updated_at,
  CASE WHEN o_orderstatus = 'P' THEN CAST(1 AS BIGINT) END AS deleted_at FROM orders)"""
