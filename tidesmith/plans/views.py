"""Signals and score tables over the driver's tables, in Spark and, as common table expressions, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .book import table

LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_shipdate")


def sig_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, idx, x): the values of a user's events in time order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("id"), (F.row_number().over(w) - 1).cast("bigint").alias("idx"), F.col("value").alias("x"))


def sig_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, idx, x, d): a supplier's prices and discounts in order."""
    w = Window.partitionBy("l_suppkey").orderBy(*LINE_KEY)
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_suppkey").alias("id"), (F.row_number().over(w) - 1).cast("bigint").alias("idx"), F.col("l_extendedprice").alias("x"), F.col("l_discount").alias("d"))


def pair_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, idx, ref, est)."""
    return sig_line(spark, sf_dir).select("id", "idx", F.col("x").alias("ref"), (F.col("x") * (1 - F.col("d"))).alias("est"))


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, method, stratum, score): the mean order price of a customer by status and priority; status F is the baseline, 'none'."""
    o = table(spark, sf_dir, "orders")
    method = F.when(F.col("o_orderstatus") == "F", "none").otherwise(F.col("o_orderstatus"))
    return o.groupBy(F.col("o_custkey").alias("id"), method.alias("method"), F.col("o_orderpriority").alias("stratum")).agg(F.avg("o_totalprice").alias("score"))


def frames_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, frame): an embedding as one frame of doubles."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("frame"))


EVENTS = "sig AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS x FROM events)"
LINES = "sig AS (SELECT l_suppkey AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_shipdate) - 1 AS idx, l_extendedprice AS x, l_discount AS d FROM lineitem)"
PAIRS = f"{LINES}, pair AS (SELECT id, idx, x AS ref, x * (1 - d) AS est FROM sig)"
EVAL = "ev AS (SELECT o_custkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'none' ELSE o_orderstatus END AS method, o_orderpriority AS stratum, avg(o_totalprice) AS score FROM orders GROUP BY 1, 2, 3)"
FRAMES = "fr AS (SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS frame FROM embeddings)"
