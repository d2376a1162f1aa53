"""The test tables as episodes, steps and outcomes, once for Spark and once as SQL text for the oracle."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a task sorts, about: a table of more is dealt to more partitions, so a task's memory does not grow with it.
TASK_ROWS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, count: int, key: str) -> DataFrame:
    """rows (about `count`) by key, where the session's partitions would have more than TASK_ROWS each; otherwise as they are."""
    parts = ceil(count / TASK_ROWS)
    return rows.repartition(parts, key) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as episodes: groups of twelve keys, 28 seeds, terminal reason by status."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    terminal = F.when(F.col("o_orderstatus") == "F", "cleared").when(F.col("o_orderstatus") == "O", "death").otherwise("max_steps")
    return o.select(
        key.alias("episode_id"),
        F.expr("o_orderkey div 12").alias("group_id"),
        (F.col("o_custkey") % 28).alias("seed"),
        terminal.alias("terminal"),
        (key % 512 + 1).alias("n_steps"),
        (key % 4).alias("deaths"),
        (F.col("o_custkey") % 97 == 0).alias("fault"),
        F.col("o_orderpriority").alias("policy"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as steps of their order, numbered by the full tie-break."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    q, items = F.col("l_quantity"), table(spark, sf_dir, "lineitem")
    items = items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return dealt(items, items.count(), "l_orderkey").select(
        F.col("l_orderkey").alias("episode_id"),
        F.row_number().over(w).cast("long").alias("step"),
        F.substring(F.lit("UDLR"), (F.col("l_partkey") % 4 + 1).cast("int"), F.lit(1)).alias("action"),
        F.when(q > 40, 10).when(q > 20, 0).otherwise(-1).cast("long").alias("delta"),
        (F.col("l_suppkey") % 5).alias("position"),
    )


EPISODES = """episodes AS (SELECT o_orderkey AS episode_id, o_orderkey // 12 AS group_id, o_custkey % 28 AS seed,
  CASE o_orderstatus WHEN 'F' THEN 'cleared' WHEN 'O' THEN 'death' ELSE 'max_steps' END AS terminal,
  o_orderkey % 512 + 1 AS n_steps, o_orderkey % 4 AS deaths, o_custkey % 97 = 0 AS fault, o_orderpriority AS policy FROM orders)"""
STEPS = """steps AS (SELECT l_orderkey AS episode_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY
  l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS step,
  substr('UDLR', (l_partkey % 4 + 1)::INT, 1) AS action,
  (CASE WHEN l_quantity > 40 THEN 10 WHEN l_quantity > 20 THEN 0 ELSE -1 END)::BIGINT AS delta, l_suppkey % 5 AS position FROM lineitem)"""
