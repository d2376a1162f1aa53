"""Rewards, advantages, intervals, exact tests and divergences as column expressions."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resampling import resampled, resampled_means

#: The 97.5 % quantile of the normal distribution (fixed value).
Z = 1.959963984540054


def success_reward(won: Column, deaths: Column, steps: Column, life_bonus: float = 0.1, speed_bonus: float = 0.05, start_lives: int = 4, horizon: int = 500) -> Column:
    """1 plus bonuses for lives and speed; 0 on a loss."""
    return F.when(won, 1.0 + life_bonus * (1 - deaths / start_lives) + speed_bonus * (1 - steps / horizon)).otherwise(F.lit(0.0))


def budget_reward(won: Column, source: Column, steps: Column, bonus: float = 0.1, horizon: int = 1000) -> Column:
    return F.when(won, 1.0 + bonus * (1 - (source + steps) / horizon)).otherwise(F.lit(0.0))


def wilson(wins: Column, n: Column, clamp: bool = True) -> tuple[Column, Column]:
    """The 95 % score interval; (0, 0) without trials."""
    p, z2 = wins / n, Z * Z
    middle, spread = (p + z2 / (2 * n)) / (1 + z2 / n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    low, high = middle - spread, middle + spread
    if clamp:
        low, high = F.greatest(low, F.lit(0.0)), F.least(high, F.lit(1.0))
    return tuple(F.when(n > 0, x).otherwise(F.lit(0.0)) for x in (low, high))


def wilson_bounds(wins: int, n: int) -> tuple[float, float]:
    """wilson() of two numbers."""
    if not n:
        return 0.0, 0.0
    p, z2 = wins / n, Z * Z
    middle, spread = (p + z2 / (2 * n)) / (1 + z2 / n), Z * math.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return max(middle - spread, 0.0), min(middle + spread, 1.0)


def centered(rewards: DataFrame) -> DataFrame:
    """Reward less its group's mean; a constant group gets exact zeros."""
    w = Window.partitionBy("group_id")
    flat = F.min("reward").over(w) == F.max("reward").over(w)
    return rewards.withColumn("advantage", F.when(flat, 0.0).otherwise(F.col("reward") - F.avg("reward").over(w)))


def standardised(rewards: DataFrame, masked: Column) -> DataFrame:
    """(reward - mean) / (population deviation + 1e-8); 0 below 1e-12; null in a masked group."""
    w = Window.partitionBy("group_id")
    sd = F.stddev_pop("reward").over(w)
    value = F.when(sd < 1e-12, 0.0).otherwise((F.col("reward") - F.avg("reward").over(w)) / (sd + 1e-8))
    return rewards.withColumn("advantage", F.when(~F.bool_or(masked).over(w), value))


def advantage_variance(rewards: DataFrame) -> DataFrame:
    """var / (sqrt(var) + 1e-5) ** 2 of each group."""
    v = F.var_samp("reward")
    return rewards.groupBy("group_id").agg((v / F.pow(F.sqrt(v) + 1e-5, 2)).alias("advantage_variance"))


def binomial_tail(k: int, n: int) -> float:
    """P(X <= k) of n fair coins, k <= n / 2: terms fall from k on, so only the first few are summed."""
    term = total = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2.0))
    while k > 0 and term > 1e-18 * total:
        term *= k / (n - k + 1)
        total += term
        k -= 1
    return total


def mcnemar(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    """Exact two-sided test of paired outcomes: twice the lesser binomial tail, at most 1; 1 without a discordant pair.

    Python sees the two counts alone.
    """

    @F.pandas_udf("double")
    def p_value(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([min(1.0, 2 * binomial_tail(min(x, y), x + y)) if x + y else 1.0 for x, y in zip(one, two, strict=True)])

    return pairs.agg(F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b")).withColumn("p_value", p_value("only_a", "only_b"))


def log_softmax(logits: Column, temperature: float = 1.0) -> Column:
    scaled = F.transform(logits, lambda x: x / temperature)
    top = F.array_max(scaled)
    norm = top + F.log(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    return F.transform(scaled, lambda x: x - norm)


def entropy(logp: Column) -> Column:
    return -F.aggregate(logp, F.lit(0.0), lambda s, x: s + F.exp(x) * x)


def divergence(logp: Column, logq: Column) -> Column:
    """KL(p || q) over one support."""
    return F.aggregate(F.zip_with(logp, logq, lambda p, q: F.exp(p) * (p - q)), F.lit(0.0), lambda s, x: s + x)


def clipped_term(ratio: Column, advantage: Column, low: float = 0.2, high: float = 0.2) -> Column:
    return F.least(ratio * advantage, F.greatest(F.least(ratio, F.lit(1 + high)), F.lit(1 - low)) * advantage)


def _covariance(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """rows with n and cov, the product of deviations from the key's means: means are aggregated, then joined back."""
    means = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("_a"), F.avg(b).alias("_b"))
    return rows.join(means, key).withColumn("cov", (F.col(a) - F.col("_a")) * (F.col(b) - F.col("_b"))).drop("_a", "_b")


def _quota(ratio: float, n: Column, eligible: Column) -> Column:
    return F.least(F.greatest(F.floor(F.lit(ratio) * n), F.lit(1)), eligible)


def clip_selection(rows: DataFrame, key: str, id_: str, advantage: str, logp: str, *, ratio: float, low: float, high: float, seed: str) -> DataFrame:
    """The rows whose covariance of advantage and log-probability is in (low, high) and that a draw by hash picks:
    floor(ratio n) of a key's n rows, one at least, as far as there are eligible ones. Only eligible rows are ordered."""
    band = _covariance(rows, key, advantage, logp).where((F.col("cov") > low) & (F.col("cov") < high))
    w = Window.partitionBy(key)
    drawn = F.sha2(F.concat_ws("|", F.lit(seed), F.col(id_).cast("string")), 256)
    placed = band.withColumns({"_place": F.row_number().over(w.orderBy(drawn, F.col(id_))), "_eligible": F.count(F.lit(1)).over(w)})
    return placed.where(F.col("_place") <= _quota(ratio, F.col("n"), F.col("_eligible"))).drop("_place", "_eligible", "n")


def clip_summary(rows: DataFrame, key: str, advantage: str, logp: str, *, ratio: float, low: float, high: float) -> DataFrame:
    """(key, decisions, eligible, selected) of clip_selection()."""
    cov = _covariance(rows, key, advantage, logp)
    counts = cov.groupBy(key).agg(F.count(F.lit(1)).alias("decisions"), F.count_if((F.col("cov") > low) & (F.col("cov") < high)).alias("eligible"))
    return counts.withColumn("selected", _quota(ratio, F.col("decisions"), F.col("eligible")))


def truncated_weight(ratio: Column, cap: float = 2.0) -> Column:
    """The importance weight of a term, cut at `cap`."""
    return F.least(ratio, F.lit(cap))


def _draw_sums(counts: DataFrame, names: list[str], rounds: int, seed: int) -> DataFrame:
    """(round, names...): for each round the sum over all rows (key, <name>_n, <name>_wins) of a binomial draw of n at wins / n.

    Counts are sufficient, so no outcome is shipped; a task adds up its own rows before anything is shuffled.
    """

    def run(batches):
        totals = np.zeros((rounds, len(names)), np.int64)
        for b in batches:
            for row in b.itertuples(index=False):
                rng = np.random.default_rng([seed, zlib.crc32(str(row[0]).encode())])
                for j in range(len(names)):
                    n, wins = int(row[1 + 2 * j]), int(row[2 + 2 * j])
                    if n:
                        totals[:, j] += rng.binomial(n, wins / n, rounds)
        if totals.any():
            yield pd.DataFrame({"round": np.arange(rounds), **{name: totals[:, j] for j, name in enumerate(names)}})

    parts = counts.mapInPandas(run, "round long, " + ", ".join(f"{n} long" for n in names))
    return parts.groupBy("round").agg(*(F.sum(n).alias(n) for n in names))


def _interval(values: DataFrame, column: str) -> DataFrame:
    """(low, high): the 2.5 and 97.5 % quantiles of a column of `rounds` rows, a bounded number."""
    return values.agg(F.percentile(column, 0.025).alias("low"), F.percentile(column, 0.975).alias("high"))


def bootstrap_rate(outcomes: DataFrame, key: str, rounds: int = 10_000, seed: int = 20261001) -> DataFrame:
    """One row (n, wins, pass_rate, low, high): outcomes are resampled within each key and pooled, as the pass rate is."""
    counts = outcomes.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.count_if("won").alias("_wins"))
    whole = counts.agg(F.sum("_n").alias("n"), F.sum("_wins").alias("wins"))
    draws = _draw_sums(counts, ["hits"], rounds, seed).crossJoin(F.broadcast(whole)).withColumn("_rate", F.col("hits") / F.col("n"))
    return whole.withColumn("pass_rate", F.col("wins") / F.col("n")).crossJoin(_interval(draws, "_rate"))  # one row each


def paired_counts(base: DataFrame, final: DataFrame, key: str) -> DataFrame:
    """(key, base_n, base_wins, final_n, final_wins); a key that only one side has is an error."""
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(f"{name}_n"), F.count_if("won").alias(f"{name}_wins"))
    both = count(base, "base").join(count(final, "final"), key, "full")
    missing = F.col("base_n").isNull() | F.col("final_n").isNull()
    return both.withColumn("base_n", F.when(missing, F.raise_error(F.lit("baseline and final cover different keys"))).otherwise(F.col("base_n")))


def clear_improvement(base: DataFrame, final: DataFrame, key: str, least: float = 0.1, rounds: int = 10_000, seed: int = 20261001) -> DataFrame:
    """One row: baseline, final, difference, low, high, clear_improvement (at least `least`, and the interval above 0), regressed keys.

    Both sides are resampled within each key and pooled; a key's two rates come from one stream of draws, final first.
    """
    counts = paired_counts(base, final, key)
    flat = counts.select(key, "final_n", "final_wins", "base_n", "base_wins")
    total = counts.agg(*(F.sum(c).alias(c) for c in ("base_n", "base_wins", "final_n", "final_wins")), F.count_if(F.col("final_wins") / F.col("final_n") < F.col("base_wins") / F.col("base_n")).alias("regressed"))
    rate = lambda side, hits=None: F.col(hits or f"{side}_wins") / F.col(f"{side}_n")
    draws = _draw_sums(flat, ["_final", "_base"], rounds, seed).crossJoin(F.broadcast(total)).withColumn("_d", rate("final", "_final") - rate("base", "_base"))
    both = total.crossJoin(_interval(draws, "_d")).withColumns({"baseline": rate("base"), "final": rate("final"), "difference": rate("final") - rate("base")})
    return both.select("baseline", "final", "difference", "low", "high", ((F.col("difference") >= least) & (F.col("low") > 0)).alias("clear_improvement"), "regressed")


def key_differences(base: DataFrame, final: DataFrame, key: str) -> DataFrame:
    """(key, base, final, difference, regressed): each key's two rates; a key regressed if its rate fell."""
    rate = lambda side: F.col(f"{side}_wins") / F.col(f"{side}_n")
    rows = paired_counts(base, final, key).select(key, rate("base").alias("base"), rate("final").alias("final"))
    return rows.withColumns({"difference": F.col("final") - F.col("base"), "regressed": F.col("final") < F.col("base")})


def cluster_rounds(base: DataFrame, final: DataFrame, key: str, rounds: int = 10_000, seed: int = 20261002) -> DataFrame:
    """(round, drawn, base, final): each round draws as many keys as there are, with replacement, and outcomes within each drawn key; the two pooled rates."""
    counts = paired_counts(base, final, key)
    units = counts.select(F.col(key).cast("string").alias("unit"), F.lit(1).cast("long").alias("copies"), "base_n", "base_wins", "final_n", "final_wins")
    found = resampled(units, rounds, seed, ("base_n", "final_n"), {"_base": ("base_n", "base_wins"), "_final": ("final_n", "final_wins")})
    return found.select("round", "drawn", (F.col("_base") / F.col("base_n")).alias("base"), (F.col("_final") / F.col("final_n")).alias("final"))


def cluster_interval(base: DataFrame, final: DataFrame, key: str, rounds: int = 10_000, seed: int = 20261002) -> DataFrame:
    """(low, high) of the difference of pooled rates over cluster_rounds()."""
    return _interval(cluster_rounds(base, final, key, rounds, seed).withColumn("_d", F.col("final") - F.col("base")), "_d")


def mean_interval(rows: DataFrame, value: str, rounds: int = 10_000, seed: int = 1, *, less: str | None = None) -> DataFrame:
    """(n, mean, low, high) of a mean by bootstrap, each round of exactly n draws; with `less`, of the mean difference value - less of paired rows."""
    v = F.col(value) - F.col(less) if less else F.col(value)
    whole = rows.select(v.cast("double").alias("v")).agg(F.count("v").alias("n"), F.avg("v").alias("mean"))
    return whole.crossJoin(_interval(resampled_means(rows, value, rounds, seed, less), "mean"))  # one row each


def delta_rounds(before: DataFrame, after: DataFrame, value: str, rounds: int = 10_000, seed: int = 1) -> DataFrame:
    """(round, drawn_before, drawn_after, delta): both sides are resampled by themselves, each to its own size."""
    one = resampled_means(before, value, rounds, 2 * seed).withColumnsRenamed({"drawn": "drawn_before", "mean": "_before"})
    two = resampled_means(after, value, rounds, 2 * seed + 1).withColumnsRenamed({"drawn": "drawn_after", "mean": "_after"})
    return one.join(two, "round").select("round", "drawn_before", "drawn_after", (F.col("_after") - F.col("_before")).alias("delta"))


def delta_interval(before: DataFrame, after: DataFrame, value: str, rounds: int = 10_000, seed: int = 1) -> DataFrame:
    """(delta, low, high) of the difference of two means of independent rows: of the rounds' differences in order, those at places
    int(0.025 rounds) and int(0.975 rounds) - 1."""
    found = delta_rounds(before, after, value, rounds, seed).agg(F.array_sort(F.collect_list("delta")).alias("_d"))  # `rounds` numbers
    at = lambda i: F.get("_d", F.lit(i))
    means = before.agg(F.avg(value).alias("_b")).crossJoin(after.agg(F.avg(value).alias("_a")))  # one row each
    ends = found.select(at(int(0.025 * rounds)).alias("low"), at(int(0.975 * rounds) - 1).alias("high"))
    return means.select((F.col("_a") - F.col("_b")).alias("delta")).crossJoin(ends)



def wilson_unclamped(wins: Column, n: Column) -> tuple[Column, Column]:
    """The score interval without the clamp to [0, 1]; no trials are an error under ANSI division."""
    p, z2 = wins / n, Z * Z
    middle, spread = (p + z2 / (2 * n)) / (1 + z2 / n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return middle - spread, middle + spread
