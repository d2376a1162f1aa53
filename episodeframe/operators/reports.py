"""Small reports and the rows they are made of: projections, plans, paired outcomes, counters of data sets and suites."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar


def compact(rows: DataFrame, *names: str, rounded: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """The named columns of summaries, some of them rounded."""
    return rows.select(*names, *(F.round(c, digits).alias(c) for c in rounded))


def without_fields(rows: DataFrame, column: str, *fields: str) -> DataFrame:
    """rows without some fields of a struct; a field that isn't there is passed over."""
    return rows.withColumn(column, F.col(column).dropFields(*fields))


def decisions_or_placeholder(episodes: DataFrame, steps: DataFrame, key: str, step: str = "step") -> DataFrame:
    """A row for each step of every episode, and for an episode without steps one at decision -1 that does not train."""
    both = episodes.select(key).join(steps.withColumnRenamed(step, "decision"), key, "left")
    return both.withColumn("trains", F.col("decision").isNotNull()).withColumn("decision", F.coalesce("decision", F.lit(-1)))


def in_roles(rows: DataFrame, roles: Mapping[str, bool]) -> DataFrame:
    """rows once for every role, with `audit_role` and whether it is `independent`."""
    listed = F.array(*(F.struct(F.lit(name).alias("audit_role"), F.lit(own).alias("independent")) for name, own in roles.items()))
    return rows.select(*rows.columns, F.inline(listed))


def active_states(states: DataFrame, update: int, probes: int, max_age: int = 20) -> DataFrame:
    """States (qualified, eligible, measured, wins) that may be started from: both flags, measured at most max_age updates ago, and won by some of `probes` but not all."""
    age = F.lit(update) - F.col("measured")
    return states.where(F.col("qualified") & F.col("eligible") & age.between(0, max_age) & (scalar.tier_label(F.col("wins"), F.lit(probes)) == "mixed"))


def limited(rows: DataFrame, step: str, most: int) -> DataFrame:
    """The first `most` steps of every episode."""
    return rows.where(F.col(step) <= most)


def paired_outcomes(pairs: DataFrame) -> DataFrame:
    """One row of pairs (p, e, fault_p, fault_e, steps_p, steps_e): how many, how many without a fault, wins that one side has alone, the mean
    difference of wins, and of steps where neither side has a fault."""
    whole = ~(F.col("fault_p") | F.col("fault_e"))
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(whole).alias("complete_pairs"), F.count_if(F.col("e") & ~F.col("p")).alias("e_only"), F.count_if(F.col("p") & ~F.col("e")).alias("p_only"),
        F.avg(F.col("e").cast("int") - F.col("p").cast("int")).alias("win_difference"), F.avg(F.when(whole, F.col("steps_e") - F.col("steps_p"))).alias("mean_gap"),
    )


def seed_plan(rows: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """Every row once with each seed of a list."""
    return rows.withColumn("seed", F.explode(F.array(*(F.lit(s).cast("long") for s in seeds))))


def in_bins(rows: DataFrame, column: str, bins: Sequence[tuple[int, int, str]]) -> DataFrame:
    """rows with the `bin` whose closed interval holds the column; rows outside all are left out, and a row in several comes with each."""
    hit = F.filter(F.array(*(F.when(F.col(column).between(low, high), name) for low, high, name in bins)), lambda b: b.isNotNull())
    return rows.withColumn("bin", F.explode(hit))


def stale_hashes(rows: DataFrame, recorded: Column, rendered: Column) -> DataFrame:
    """Rows whose recorded SHA-256 is not that of the text rendered again; one without a hash is stale."""
    return rows.where(~recorded.eqNullSafe(F.sha2(rendered, 256)))


def split_counters(rows: DataFrame, split: Column, *by: str) -> DataFrame:
    """(split, by..., n): how often each combination stands."""
    return rows.groupBy(split.alias("split"), *by).agg(F.count(F.lit(1)).alias("n"))


def plan_statistics(draws: DataFrame, item: str, frame: str, large: Column) -> DataFrame:
    """One row: draws, distinct items and frames, how often the most drawn item is, and the share of draws that are `large`."""
    per = draws.groupBy(item).agg(F.count(F.lit(1)).alias("c"), F.count_if(large).alias("l"))
    whole = per.agg(F.sum("c").alias("draws"), F.count(F.lit(1)).alias("distinct_items"), F.max("c").alias("max_repeat"), (F.sum("l") / F.sum("c")).alias("large_fraction"))
    return whole.crossJoin(draws.agg(F.count_distinct(frame).alias("distinct_frames")))  # one row each


def suite_summary(suite: DataFrame, layout: Column, topology: Column, steps: str) -> DataFrame:
    """One row: layouts, how many differ in their text and in their topology (by SHA-256), the fewest and most steps."""
    return suite.agg(
        F.count(F.lit(1)).alias("layouts"), F.count_distinct(F.sha2(layout, 256)).alias("distinct_layouts"), F.count_distinct(F.sha2(topology, 256)).alias("distinct_topologies"),
        F.min(steps).alias("least_steps"), F.max(steps).alias("most_steps"),
    )


def agent_evaluation(rows: DataFrame, agent: str) -> DataFrame:
    """(agent, episodes, win_rate, mean_score, mean_steps) of rows (won, score, n_steps)."""
    return rows.groupBy(agent).agg(F.count(F.lit(1)).cast("double").alias("episodes"), F.avg(F.col("won").cast("int")).alias("win_rate"), F.avg("score").alias("mean_score"), F.avg("n_steps").alias("mean_steps"))


def route_summary(seeds: DataFrame, rows: DataFrame, key: str = "seed") -> DataFrame:
    """(key, examples, wins, reward_min, reward_max, reward_mean) of every seed; those without examples have no extremes and no mean."""
    marked = rows.select(key, "won", "reward", F.lit(1).alias("_one"))
    return seeds.join(marked, key, "left").groupBy(key).agg(F.count("_one").alias("examples"), F.count_if("won").alias("wins"), F.min("reward").alias("reward_min"), F.max("reward").alias("reward_max"), F.avg("reward").alias("reward_mean"))
