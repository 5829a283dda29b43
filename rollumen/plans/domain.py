"""Trajectories and tokens, derived from the star-schema tables in the same way in Spark and in oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax", "l_returnflag")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, uid, data_source): one row for each order; a customer's orders are a group."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("uid"), F.col("o_orderpriority").alias("data_source")
    )


def token_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens without their group, so that a query that needs none has no join."""
    w = Window.partitionBy("l_orderkey").orderBy(*ORDER)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("row_id"),
        (F.row_number().over(w) - 1).alias("t"),
        (F.col("l_returnflag") != "R").cast("int").alias("mask"),
        (-0.1 - F.col("l_discount") * 5).alias("logp_old"),
        (-(F.col("l_quantity") / 50)).alias("logp_new"),
        (-0.1 - F.col("l_tax") * 5).alias("logp_rollout"),
        (-0.1 - F.col("l_discount") * 2).alias("logp_ref"),
        (F.floor(F.col("l_extendedprice") / 100) / 997.0).alias("reward"),
        (F.col("l_quantity") / 50).alias("value"),
        (0.3 + F.col("l_tax")).alias("sum_pi_sq"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_lines(spark, sf_dir).join(trajectories(spark, sf_dir).select("row_id", "uid"), "row_id")


#: Common table expressions for oracle SQL: traj, tok0 (no group) and tok.
TRAJ = "traj AS (SELECT o_orderkey AS row_id, o_custkey AS uid, o_orderpriority AS data_source FROM orders)"
TOK0 = f"""tok0 AS (SELECT l_orderkey AS row_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) - 1 AS INTEGER) AS t,
  CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS mask, -0.1 - l_discount * 5 AS logp_old, -(l_quantity / 50) AS logp_new,
  -0.1 - l_tax * 5 AS logp_rollout, -0.1 - l_discount * 2 AS logp_ref, floor(l_extendedprice / 100) / 997.0 AS reward,
  l_quantity / 50 AS value, 0.3 + l_tax AS sum_pi_sq FROM lineitem)"""
TOK = f"{TRAJ}, {TOK0}, tok AS (SELECT tok0.*, traj.uid FROM tok0 JOIN traj USING (row_id))"
#: One row for each trajectory with tokens: score, length (valid tokens).
ROWS = f"{TOK}, sc AS (SELECT row_id, uid, sum(reward) AS score, sum(mask) AS length FROM tok GROUP BY row_id, uid)"


def scores_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, uid, score, length) of trajectories with tokens."""
    return tokens(spark, sf_dir).groupBy("row_id", "uid").agg(F.sum("reward").alias("score"), F.sum("mask").alias("length"))
