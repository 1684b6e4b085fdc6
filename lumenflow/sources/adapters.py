"""The test tables seen as frames, score streams and candidate pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as one video."""
    return table(spark, sf_dir, "embeddings").select(F.lit("v0").alias("video"), F.col("vec_id").cast("int").alias("frame_idx"), F.col("vec_id").cast("double").alias("ts"), F.col("embedding").alias("emb"))


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings by label as videos."""
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("label").cast("string")).alias("video"), F.col("vec_id").cast("int").alias("frame_idx"), F.col("vec_id").cast("double").alias("ts"), F.col("embedding").alias("emb"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 as a query against all rows."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").cast("int").alias("query_id"), F.col("embedding").alias("q"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as score streams: a video is a user, a query a type; seconds and value - 50."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("video"), F.col("event_type").alias("query_id"), F.col("event_id").alias("frame_idx"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), (F.col("value") - 50).alias("score"))


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates of a customer's group: positive if urgent, scored by their line prices."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_extendedprice")).alias("scores"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("group"), (F.col("o_orderpriority") == "1-URGENT").alias("is_positive"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("group", F.col("o_orderkey").alias("item"), "is_positive", "scores")
