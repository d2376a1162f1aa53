"""Episode, group and batch aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .orderstats import linear_quantiles

ACTIONS = ("U", "D", "L", "R", "S")


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def episode_headers(steps: DataFrame) -> DataFrame:
    """One header an episode from its steps: totals over all, last action and position by step."""
    return steps.groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("steps"),
        F.sum("delta").alias("score"),
        F.count_if(F.col("delta") > 0).alias("gains"),
        F.max_by("action", "step").alias("last_action"),
        F.max_by("position", "step").alias("last_position"),
    )


def action_counts(steps: DataFrame) -> DataFrame:
    """Actions counted densely: an action that never occurs has 0."""
    return steps.agg(*(F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ACTIONS), F.count(F.lit(1)).alias("total"))


def terminal_histogram(episodes: DataFrame, *by: str) -> DataFrame:
    return episodes.groupBy(*by, "terminal").agg(F.count(F.lit(1)).alias("n"))


def pass_rates(episodes: DataFrame, *by: str) -> DataFrame:
    """Games, wins and pass rate by key; a win is the terminal reason `cleared`."""
    won = F.count_if(F.col("terminal") == "cleared")
    return episodes.groupBy(*by).agg(F.count(F.lit(1)).alias("games"), won.alias("wins"), share(won, F.count(F.lit(1))).alias("pass_rate"))


def group_spread(rewards: DataFrame) -> DataFrame:
    """Per group: members, range, distinct rewards; the three tests of a degenerate group stay apart."""
    return rewards.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("members"),
        ((F.count(F.lit(1)) < 2) | (F.max("reward") - F.min("reward") > 1e-4)).alias("range_informative"),
        (F.min("reward") != F.max("reward")).alias("unequal"),
        (F.count_distinct("reward") > 1).alias("many_values"),
    )


def informative(rewards: DataFrame) -> DataFrame:
    """Rows of the groups whose rewards are not all identical."""
    spread = group_spread(rewards).where("unequal").select("group_id")
    return rewards.join(spread, "group_id", "left_semi")


def rollout_metrics(samples: DataFrame) -> DataFrame:
    """Episodes, win rate (reward of 1 or more), mean reward, share of groups whose rewards are all equal, median steps of won episodes.

    samples (group_id, episode_id, reward, won, n_steps) may hold an episode several times, once a decision: it counts once.
    """
    episodes = samples.groupBy("group_id", "episode_id").agg(F.max("reward").alias("reward"), F.max(F.when(F.col("won"), F.col("n_steps"))).alias("won_steps"))
    groups = episodes.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("reward") >= 1).alias("wins"), F.sum("reward").alias("total"), (F.min("reward") == F.max("reward")).alias("flat")
    )
    n = F.sum("n")
    whole = groups.agg(n.alias("episodes"), share(F.sum("wins"), n).alias("win_rate"), share(F.sum("total"), n).alias("mean_reward"), share(F.count_if("flat"), F.count(F.lit(1))).alias("zero_variance_groups"))
    middle = linear_quantiles(episodes, [], "won_steps", {"success_steps_median": 0.5})
    return whole.join(F.broadcast(middle), how="left", on=F.lit(True))  # one row each


def probe_summary(rewards: DataFrame, *by: str) -> DataFrame:
    """Mean over groups of mean reward and sample variance."""
    groups = rewards.groupBy(*by, "group_id").agg(F.count(F.lit(1)).alias("n"), F.avg("reward").alias("m"), F.var_samp("reward").alias("v"))
    return groups.groupBy(*by).agg(F.sum("n").alias("episodes"), F.count(F.lit(1)).alias("groups"), F.avg("m").alias("mean_reward"), F.avg("v").alias("mean_variance"))


def multi_key_rollup(rows: DataFrame, keys: list[Column], hit: Column) -> DataFrame:
    """One row counts under each of its keys."""
    return rows.select(F.explode(F.array_distinct(F.array(*keys))).alias("key"), hit.alias("hit")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))


def two_denominators(attempts: DataFrame, *by: str) -> DataFrame:
    """Win rate per attempt and per planned trial: a fault is no win, and counts in the plan only."""
    tried, won = F.count_if(~F.col("fault")), F.count_if((F.col("terminal") == "cleared") & ~F.col("fault"))
    return attempts.groupBy(*by).agg(F.count(F.lit(1)).alias("planned"), tried.alias("tried"), won.alias("wins"), share(won, tried).alias("win_rate"), share(won, F.count(F.lit(1))).alias("planned_win_rate"))


def window_totals(batches: DataFrame, size: int = 5) -> DataFrame:
    """Games and wins over the last `size` batches of each tier, by update."""
    w = Window.partitionBy("tier").orderBy("update").rowsBetween(1 - size, 0)
    return batches.withColumns({"window_games": F.sum("games").over(w), "window_wins": F.sum("wins").over(w), "window_maps": F.size(F.array_distinct(F.flatten(F.collect_list("maps").over(w)))).cast("long")})


def importance_weights(frames: DataFrame, layout: str, row: str, position: str) -> DataFrame:
    """1 / (layouts * rows of the layout * positions of the row * frames at the position): each level gets an equal share."""
    at = frames.groupBy(layout, row, position).agg(F.count(F.lit(1)).alias("frames"))
    rows = at.groupBy(layout, row).agg(F.count(F.lit(1)).alias("positions"))
    layouts = rows.groupBy(layout).agg(F.count(F.lit(1)).alias("rows"))
    total = layouts.agg(F.count(F.lit(1)).alias("layouts"))
    both = at.join(rows, [layout, row]).join(layouts, layout).crossJoin(F.broadcast(total))  # total is one row
    return both.withColumn("weight", 1.0 / (F.col("layouts") * F.col("rows") * F.col("positions") * F.col("frames")))


def masked_moments(rows: DataFrame, value: str, mask: Column) -> DataFrame:
    kept = F.when(mask, F.col(value))
    return rows.agg(F.count(kept).alias("n"), F.avg(kept).alias("mean"), F.greatest(F.var_pop(kept), F.lit(0.0)).alias("variance"), F.min(kept).alias("least"), F.max(kept).alias("most"))


def latest_metrics(events: DataFrame, *by: str) -> DataFrame:
    """The last value of every key of a step: later lines win."""
    return events.groupBy(*by).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def batch_plan(episodes: DataFrame) -> DataFrame:
    """Any fault masks its whole group; the loss denominator stays the number of attempts."""
    groups = episodes.groupBy("group_id").agg(F.count(F.lit(1)).alias("attempts"), F.bool_or("fault").alias("masked"), F.sort_array(F.collect_list(F.when(F.col("fault"), F.col("episode_id")))).alias("faults"))
    return groups.withColumns({"eligible": F.when(F.col("masked"), 0).otherwise(F.col("attempts")), "n_faults": F.size("faults").cast("long")})


def batch_plan_summary(episodes: DataFrame) -> DataFrame:
    """One row: the loss denominator (all attempts), valid outcomes, eligible, excluded and informative groups, and why the loss is skipped, if it is.

    A fault excludes its whole group; a group is informative if its rewards spread.
    """
    groups = episodes.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("fault").alias("f"), (F.stddev_pop("reward") >= 1e-12).alias("s"))
    eligible, informative = F.count_if(F.col("f") == 0), F.count_if((F.col("f") == 0) & F.col("s"))
    why = F.when(eligible == 0, "no_complete_valid_groups").when(informative == 0, "no_within_complete_group_advantage")
    return groups.agg(F.sum("n").alias("loss_denominator"), (F.sum("n") - F.sum("f")).alias("valid_outcomes"), eligible.alias("eligible"), F.count_if(F.col("f") > 0).alias("excluded"), informative.alias("informative"), why.alias("skip_reason"))


def weighted_mean(rows: DataFrame, value: str, weight: str, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(share(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean"), F.sum(weight).alias("weight"))


def padded(rows: DataFrame, key: str, multiple: int) -> DataFrame:
    """Placeholder rows that bring each key's count to a multiple."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("have"))
    gap = F.expr(f"pmod(-have, {multiple})")
    return n.withColumn("missing", gap).where("missing > 0").select(key, "have", F.explode(F.sequence(F.lit(1).cast("long"), F.col("missing"))).alias("slot"))
