"""Fail-closed validation: a table of rules, evaluated in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A row breaks the rule where `broken` is true or null."""

    name: str
    broken: Column


def violations(rows: DataFrame, rules: list[Rule], *key: str) -> DataFrame:
    """(key, rule) for every broken rule of every row; all are reported, not only the first."""
    found = F.filter(F.array(*(F.when(F.coalesce(r.broken, F.lit(True)), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull())
    return rows.select(*key, F.explode(found).alias("rule"))


def clean(rows: DataFrame, rules: list[Rule], *key: str) -> DataFrame:
    """rows; the query fails when a row breaks a rule."""
    broken = F.array_join(F.array(*(F.when(F.coalesce(r.broken, F.lit(True)), F.lit(r.name)) for r in rules)), ", ")
    marked = rows.withColumn("_broken", broken)
    return marked.where(F.when(F.col("_broken") == "", True).otherwise(F.raise_error(F.concat_ws(": ", *(F.col(k).cast("string") for k in key), "_broken")))).drop("_broken")


def quarantined(rows: DataFrame, rules: list[Rule], *key: str) -> DataFrame:
    """rows of the keys that break no rule."""
    return rows.join(violations(rows, rules, *key).select(*key).distinct(), list(key), "left_anti")


def ledger_rules() -> list[Rule]:
    """What a header (steps, score) must share with the sums of its episode's steps."""
    return [Rule("steps", F.col("seen") != F.col("steps")), Rule("contiguous", F.col("jumps") > 0), Rule("balance", F.col("balance") != F.col("score"))]


def ledger_sums(steps: DataFrame) -> DataFrame:
    """seen, balance and jumps (steps that do not follow the one before by one) of every episode."""
    w = Window.partitionBy("episode_id").orderBy("step")
    own = steps.withColumn("_jump", F.col("step") != F.coalesce(F.lag("step").over(w), F.lit(0)) + 1)
    return own.groupBy("episode_id").agg(F.count(F.lit(1)).alias("seen"), F.sum("delta").alias("balance"), F.count_if("_jump").alias("jumps"))


def ledger_mismatches(headers: DataFrame, steps: DataFrame) -> DataFrame:
    """Episodes whose header disagrees with its steps: number of steps, contiguity, final balance."""
    return violations(headers.join(ledger_sums(steps), "episode_id", "left"), ledger_rules(), "episode_id")


def homogeneous(rows: DataFrame, by: str, contract: str) -> DataFrame:
    """(key, contracts, homogeneous): whether all rows of a key share one contract."""
    n = F.count_distinct(contract)
    return rows.groupBy(by).agg(n.alias("contracts"), (n == 1).alias("homogeneous"))
