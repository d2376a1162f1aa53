"""Registration of queries with their SQL, and the tables and rounding they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import statistics
from ..sources.bindings import EPISODES, episodes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "nm8_group_centering"

REWARDS = f"""{EPISODES}, rewards AS (SELECT *, CASE WHEN terminal = 'cleared'
  THEN 1.0::DOUBLE + 0.1::DOUBLE * (1 - deaths / 4) + 0.05::DOUBLE * (1 - n_steps / 500) ELSE 0.0::DOUBLE END AS reward FROM episodes)"""
TIE = ["ts", "event_id"]


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = episodes(spark, sf_dir)
    return e.withColumn("reward", statistics.success_reward(F.col("terminal") == "cleared", F.col("deaths"), F.col("n_steps")))


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]
