"""Summaries of played episodes, comparisons of evaluations, gates and picks built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import wilson
from .aggregates import ACTIONS, share
from .orderstats import linear_quantiles, nearest_ranks
from .scans import runs
from .selection import natural_key


def summarised(headers: DataFrame, steps: DataFrame, *by: str) -> DataFrame:
    """The full episode summary by key: averages and rates of headers (episode_id, clear_rate, normal_clear_rate, pellets_eaten, pellets_left,
    power_left, won, parse_failures, violations, n_steps, base_reward, shaped_reward, score, walls, oscillations, deaths, terminal), and what
    steps (episode_id, step, action, delta, reasoning) add: actions counted densely, reasoning turns, longest runs without a gain."""
    turn = Window.partitionBy("episode_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    runs = steps.withColumn("_island", F.count_if(F.col("delta") > 0).over(turn)).groupBy("episode_id", "_island").agg(
        F.count_if(F.col("delta") <= 0).alias("_dry"), *(F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ACTIONS), F.count_if(F.trim("reasoning") != "").alias("reasoning_turns")
    )
    counted = [f"n_{a}" for a in ACTIONS] + ["reasoning_turns"]
    per = runs.groupBy("episode_id").agg(F.max("_dry").alias("_streak"), *(F.sum(c).alias(c) for c in counted))
    both = headers.join(per, "episode_id", "left").fillna(0, ["_streak", *counted])
    length = F.greatest("n_steps", F.lit(1))
    means = {
        "pellet_clear_rate": F.col("clear_rate"), "normal_pellet_clear_rate": F.col("normal_clear_rate"), "normal_pellets_eaten": F.col("pellets_eaten"), "episode_length": F.col("n_steps"),
        "base_reward": F.col("base_reward"), "shaped_reward": F.col("shaped_reward"), "final_score": F.col("score"), "wall_collisions": F.col("walls"), "wall_hit_rate": F.col("walls") / length,
        "oscillation_returns": F.col("oscillations"), "oscillation_rate": F.col("oscillations") / length, "normal_pellets_remaining": F.col("pellets_left"), "power_pellets_remaining": F.col("power_left"),
        "death_count": F.col("deaths"), "max_no_progress_streak": F.col("_streak"),
    }
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("episodes"),
        *(F.avg(c).alias(f"average_{n}") for n, c in means.items()),
        F.count_if("won").alias("full_completions"),
        F.sum("parse_failures").alias("parse_failures"),
        F.sum("violations").alias("canonical_action_violations"),
        share(F.count_if(F.col("terminal") == "max_steps"), F.count(F.lit(1))).alias("max_step_rate"),
        F.max("_streak").alias("max_no_progress_streak"),
        *(F.sum(c).alias(c) for c in counted),
    )


def legacy_summary(headers: DataFrame) -> DataFrame:
    """One row whatever the input: episodes, wins, mean reward and steps; all 0 for no episodes."""
    return headers.agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if("won").alias("wins"), F.coalesce(F.avg("shaped_reward"), F.lit(0.0)).alias("avg_reward"), F.coalesce(F.avg("n_steps"), F.lit(0.0)).alias("avg_steps")
    )


def counters(rows: DataFrame, name: str, missing: str) -> DataFrame:
    """(key, n) of a column, null under `missing`."""
    return rows.groupBy(F.coalesce(F.col(name).cast("string"), F.lit(missing)).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def in_batches(rows: DataFrame, stream: str, order: list[str], split: str, sizes: dict[str, int]) -> DataFrame:
    """rows with `batch` and `broken`: each stream is cut in order; a batch starts where the one before is full and takes its size from the split it starts with.

    A change of split inside a batch breaks it (an error in a strict reader). As long as no batch is broken,
    batches are runs of one split cut by its size, so no sequential scan is needed.
    """
    size = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col(split)]
    placed = runs(rows, [stream], order, split).withColumn("_size", size)
    part = F.expr("_at div _size")
    # a run that does not fill its last batch is followed by another split inside that batch
    broken = (F.col("run") < F.col("_last")) & ((part + 1) * F.col("_size") > F.col("_n"))
    return placed.withColumns({"batch": part, "broken": broken}).drop("_size", "_at", "_n", "_last")


def batch_summary(batches: DataFrame, *by: str) -> DataFrame:
    """Size, mean, least and greatest score, rates, distinct decoding contracts (as a sorted list) of each batch."""
    return batches.groupBy(*by).agg(
        F.count(F.lit(1)).alias("episodes"), F.avg("score").alias("average_score"), F.min("score").alias("minimum_score"), F.max("score").alias("maximum_score"),
        F.avg(F.col("walls") / F.greatest("n_steps", F.lit(1))).alias("average_wall_hit_rate"), F.count_if("won").alias("full_completions"),
        F.array_join(F.sort_array(F.collect_set("contract")), ";").alias("contracts"),
    )


def panel_metrics(rows: DataFrame, panel: str) -> DataFrame:
    """Win rate and mean reward of each panel, and of all under `all`."""
    keyed = rows.select(F.explode(F.array(F.col(panel).cast("string"), F.lit("all"))).alias("panel"), "won", "reward")
    return keyed.groupBy("panel").agg(share(F.count_if("won"), F.count(F.lit(1))).alias("win_rate"), F.avg("reward").alias("mean_reward"))


def eval_metrics(samples: DataFrame) -> DataFrame:
    """(name, episodes, win_rate, mean_reward, success_steps_median) of decisions (name, episode_id, reward, won, n_steps, version), each episode counted once.

    An episode with two rewards, and a set with more than one weight version, are errors.
    """
    once = samples.groupBy("name", "episode_id").agg(F.min("reward").alias("reward"), F.max("reward").alias("_max"), F.max(F.when(F.col("won"), F.col("n_steps"))).alias("steps"), F.min("version").alias("_v"), F.max("version").alias("_w"))
    wrong = F.when(F.col("reward") != F.col("_max"), F.raise_error(F.lit("inconsistent episode reward"))).otherwise(F.col("reward"))
    per = once.groupBy("name").agg(F.count(F.lit(1)).alias("episodes"), share(F.count_if(wrong >= 1), F.count(F.lit(1))).alias("win_rate"), F.avg("reward").alias("mean_reward"), F.min("_v").alias("_v"), F.max("_w").alias("_w"))
    mixed = F.when(F.col("_v") != F.col("_w"), F.raise_error(F.lit("evaluation mixes weight versions"))).otherwise(F.col("episodes"))
    return per.withColumn("episodes", mixed).drop("_v", "_w").join(linear_quantiles(once, ["name"], "steps", {"success_steps_median": 0.5}), "name", "left")


def probe_states(rows: DataFrame, least: int = 24, group_size: int = 12) -> DataFrame:
    """Per state: samples, successes, rate with its Wilson interval, mean reward, mean over groups of the sample variance and of var / (sqrt(var) + 1e-5)^2,
    and how many groups don't have `group_size` members."""
    v = F.var_samp("reward")
    groups = rows.groupBy("state", "group_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("won").alias("w"), F.sum("reward").alias("r"), v.alias("v"), (v / F.pow(F.sqrt(v) + 1e-5, 2)).alias("a"))
    per = groups.groupBy("state").agg(
        F.sum("n").alias("samples"), F.sum("w").alias("successes"), (F.sum("r") / F.sum("n")).alias("mean_reward"), F.avg("v").alias("group_reward_variance"), F.avg("a").alias("advantage_variance"), F.count_if(F.col("n") != group_size).alias("odd_groups")
    )
    low, high = wilson(F.col("successes"), F.col("samples"))
    return per.withColumns({"success_rate": share(F.col("successes"), F.col("samples")), "low": low, "high": high, "adequate": F.col("samples") >= least})


def alignment(rows: DataFrame, by: str, max_tolerance: float, mean_tolerance: float) -> DataFrame:
    """Differences (delta) of two log-probabilities by key: signed mean, mean and root-mean-square of the absolute value, nearest-rank percentiles, masked-out actions and other versions."""
    absolute = rows.withColumn("_abs", F.abs("delta"))
    per = absolute.groupBy(by).agg(
        F.count(F.lit(1)).alias("tokens"), F.avg("delta").alias("signed_mean"), F.avg("_abs").alias("mean_abs"), F.sqrt(F.avg(F.col("delta") * F.col("delta"))).alias("rms"), F.max("_abs").alias("max_abs"),
        F.count_if(F.col("mask").bitwiseAND(F.col("bit")) == 0).alias("mask_violations"), F.count_if(F.col("version") != F.col("current_version")).alias("version_mismatches"),
    )
    ranks = nearest_ranks(absolute, [by], "_abs", {"p50_abs": 0.5, "p95_abs": 0.95, "p99_abs": 0.99})
    fine = (F.col("mask_violations") == 0) & (F.col("version_mismatches") == 0) & (F.col("max_abs") <= max_tolerance) & (F.col("mean_abs") <= mean_tolerance)
    return per.join(ranks, by).withColumn("aligned", fine)


def categories_rollup(rows: DataFrame) -> DataFrame:
    """Scores (task, size, categories, valid, exact) counted under `all`, task, task@size and each task:category."""
    keys = F.concat(F.array(F.lit("all"), F.col("task"), F.concat_ws("@", "task", "size")), F.transform(F.coalesce("categories", F.array().cast("array<string>")), lambda c: F.concat_ws(":", F.col("task"), c)))
    return rows.select(F.explode(keys).alias("key"), "valid", "exact").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("valid"), F.count_if("exact").alias("exact"))


def best_checkpoint(summaries: DataFrame, purpose: Column | None = None) -> DataFrame:
    """The label with the greatest (win share, clear rate), the earlier in natural order on a tie; the base, labels with errors and labels without a clear rate don't count.

    Nothing is picked from evaluations that are not for validation.
    """
    fit = (F.col("label") != "base") & (F.col("errors") == 0) & F.col("clear_rate").isNotNull()
    if purpose is not None:
        fit = fit & (purpose == "validation")
    return summaries.where(fit).orderBy((F.col("wins") / F.col("episodes")).desc(), F.col("clear_rate").desc(), natural_key(F.col("label"))).limit(1)


def best_update(summaries: DataFrame) -> DataFrame:
    """The update with the greatest (wins, clear rate, shaped reward, less wall hits, less oscillation); the first in natural order on a tie."""
    order = [F.col("wins").desc(), F.col("clear_rate").desc(), F.col("shaped_reward").desc(), F.col("wall_rate"), F.col("oscillation_rate"), natural_key(F.col("label"))]
    return summaries.orderBy(*order).limit(1)


def earliest_learnable(summaries: DataFrame, states: DataFrame, *, least: int = 24, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """The earliest state (env_step, then id) with enough samples and a success rate in [low, high]; a summary of an unknown state is an error."""
    both = summaries.join(states.select("state", "env_step"), "state", "left")
    known = F.when(F.col("env_step").isNull(), F.raise_error(F.lit("probe of an unknown state"))).otherwise(F.col("env_step"))
    return both.withColumn("env_step", known).where((F.col("samples") >= least) & F.col("success_rate").between(low, high)).orderBy("env_step", "state").limit(1)


def retained(updates: DataFrame) -> DataFrame:
    """(update, latest, best, pending) of the checkpoints (update, wins, episodes, pending) that stay: the last, the best (exact ratio of wins, the earlier on a tie) and pending ones.

    Ratios are compared by whole numbers: wins * 10**18 / episodes never rounds two different ones together below 10**9 episodes.
    """
    exact = F.col("wins").cast("decimal(38,0)") * F.lit(10**18).cast("decimal(19,0)")
    rate = (exact / F.col("episodes").cast("decimal(18,0)")).cast("decimal(38,6)")
    top = updates.agg(F.max("update").alias("_last"), F.max_by("update", F.struct(F.when(F.col("episodes") > 0, rate), -F.col("update"))).alias("_best"))
    marked = updates.crossJoin(F.broadcast(top))  # one row
    flags = marked.select("update", (F.col("update") == F.col("_last")).alias("latest"), (F.col("update") == F.col("_best")).alias("best"), "pending")
    return flags.where("latest OR best OR pending")


def distribution_report(pairs: DataFrame, key: str, *, max_delta: float, max_kl: float) -> DataFrame:
    """Of log-probabilities old, new (arrays over one support): largest and median absolute difference, KL(old || new) after normalising both, ratio bounds, share of ratios outside [0.8, 1.2], pass flag."""
    delta = F.zip_with("new", "old", lambda n, o: n - o)
    norm = lambda c: F.log(F.aggregate(c, F.lit(0.0), lambda s, x: s + F.exp(x)))
    flat = lambda c: F.transform(c, lambda x: x - norm(c))
    kl = F.greatest(F.lit(0.0), F.aggregate(F.zip_with(flat(F.col("old")), flat(F.col("new")), lambda p, q: F.exp(p) * (p - q)), F.lit(0.0), lambda s, x: s + x))
    rows = pairs.withColumns({"_abs": F.array_sort(F.transform(delta, F.abs)), "_ratio": F.transform(delta, F.exp), "kl": kl})
    n = F.size("_abs")
    middle = (F.element_at("_abs", ((n - 1) / 2).cast("int") + 1) + F.element_at("_abs", (n / 2).cast("int") + 1)) / 2
    outside = F.size(F.filter("_ratio", lambda r: (r < 0.8) | (r > 1.2))) / n
    report = rows.select(key, n.cast("long").alias("actions"), middle.alias("p50"), F.element_at("_abs", -1).alias("max_delta"), "kl", F.array_min("_ratio").alias("ratio_min"), F.array_max("_ratio").alias("ratio_max"), outside.alias("outside_clip"))
    return report.withColumn("passed", (F.col("max_delta") <= max_delta) & (F.col("kl") <= max_kl))


def drift(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(decisions, argmax_agreement, kl) of two tables (key, logp) of distributions over one support."""
    both = a.select(key, F.col("logp").alias("_p")).join(b.select(key, F.col("logp").alias("_q")), key)
    top = lambda c: F.array_position(c, F.array_max(c))
    kl = F.aggregate(F.zip_with("_p", "_q", lambda p, q: F.exp(p) * (p - q)), F.lit(0.0), lambda s, x: s + x)
    return both.agg(F.count(F.lit(1)).alias("decisions"), F.avg((top(F.col("_p")) == top(F.col("_q"))).cast("int")).alias("argmax_agreement"), F.avg(kl).alias("kl"))


def choice_entropy(rows: DataFrame, logp: str = "logp") -> DataFrame:
    """Mean entropy over decisions with more than one legal move, and the share that is nearly certain (below 0.01)."""
    norm = F.log(F.aggregate(logp, F.lit(0.0), lambda s, x: s + F.exp(x)))
    p = rows.where(F.size(logp) > 1).withColumn("_h", -F.aggregate(F.transform(logp, lambda x: x - norm), F.lit(0.0), lambda s, x: s + F.exp(x) * x))
    return p.agg(F.count(F.lit(1)).alias("decisions"), F.avg("_h").alias("entropy"), share(F.count_if(F.col("_h") < 0.01), F.count(F.lit(1))).alias("near_zero"))


def accuracy_drop(probes: DataFrame, most: float = 0.1) -> DataFrame:
    """(rollout, accuracy, drop, failed): accuracy of each rollout's cases (rollout, correct) against that of the first rollout."""
    per = probes.groupBy("rollout").agg(F.avg(F.col("correct").cast("int")).alias("accuracy"))
    first = per.agg(F.min_by("accuracy", "rollout").alias("_first"))
    return per.crossJoin(F.broadcast(first)).select("rollout", "accuracy", (F.col("_first") - F.col("accuracy")).alias("drop"), (F.col("_first") - F.col("accuracy") > most).alias("failed"))  # one row


def largest_scenario(cases: DataFrame, limit: int) -> DataFrame:
    """The case with the most tokens (the first by order on a tie), what it leaves of the limit, and whether it stays strictly below."""
    top = cases.agg(F.max_by(F.struct("scenario", "tokens"), F.struct("tokens", -F.col("at"))).alias("t"))
    return top.select("t.scenario", "t.tokens", (F.lit(limit) - F.col("t.tokens")).alias("headroom"), (F.col("t.tokens") < limit).alias("passed"))


def pilot_gate(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Gates of probes before and after (key, samples, low, high, mean_reward, mean_pellets, group_variance, advantage_variance): enough samples, intervals apart, reward or progress up, spread on both sides."""
    b, a = (df.select(key, *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c != key)) for df, p in ((before, "b"), (after, "a")))
    both = b.join(a, key)
    gates = {
        "adequate": (F.col("b_samples") >= 24) & (F.col("a_samples") >= 24),
        "apart": F.col("a_low") > F.col("b_high"),
        "progress": (F.col("a_mean_reward") > F.col("b_mean_reward")) | (F.col("a_mean_pellets") > F.col("b_mean_pellets")),
        "signal": F.coalesce(F.col("a_advantage_variance") > 1e-12, F.lit(False)),
        "dispersion": F.coalesce(F.col("b_group_variance") > 0, F.lit(False)),
    }
    out = both.select(key, *(c.alias(n) for n, c in gates.items()))
    return out.withColumn("passed", F.expr(" AND ".join(gates)))


def progress_gate(pairs: DataFrame) -> DataFrame:
    """Rows (before, after, parse_failures, violations) with progress, clean and accepted: half cleared and 20 points gained, or 90 % from above half."""
    gain = F.col("after") - F.col("before")
    progress = ((F.col("after") >= 0.5) & (gain >= 0.2)) | ((F.col("before") > 0.5) & (F.col("after") >= 0.9))
    clean = (F.col("parse_failures") == 0) & (F.col("violations") == 0)
    return pairs.withColumns({"improvement": gain * 100, "progress": progress, "clean": clean, "accepted": progress & clean})


def overfit_gate(base: DataFrame, trained: DataFrame) -> DataFrame:
    """(label, clear_delta, passed) of trained summaries against the one row of the base: clear rate up 0.1, more pellets, reward or wins up, wall hits up 0.05 at most."""
    names = ("clear_rate", "pellets", "shaped_reward", "wins", "wall_rate")
    both = trained.crossJoin(F.broadcast(base.select(*(F.col(c).alias(f"_{c}") for c in names))))  # base is one row
    d = {c: F.col(c) - F.col(f"_{c}") for c in names}
    ok = (d["clear_rate"] >= 0.1) & (d["pellets"] > 0) & ((d["shaped_reward"] > 0) | (d["wins"] > 0)) & (d["wall_rate"] <= 0.05)
    return both.select("label", d["clear_rate"].alias("clear_delta"), ok.alias("passed"))


def screened(rows: DataFrame, size: int) -> DataFrame:
    """(state, samples, successes, success_rate, low, high, complete) of screening rows (state, i, won): complete where the indices are exactly 0..size-1."""
    per = rows.groupBy("state").agg(
        F.count(F.lit(1)).alias("samples"), F.count_if("won").alias("successes"), ((F.count(F.lit(1)) == size) & (F.count_distinct("i") == size) & (F.min("i") == 0) & (F.max("i") == size - 1)).alias("complete")
    )
    low, high = wilson(F.col("successes"), F.col("samples"))
    return per.withColumns({"success_rate": share(F.col("successes"), F.col("samples")), "low": low, "high": high})


def before_and_after(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, before, after, change, apart) of keys that both probes (key, success_rate, low, high) have; others are passed over."""
    b = before.select(key, F.col("success_rate").alias("before"), F.col("high").alias("_high"))
    a = after.select(key, F.col("success_rate").alias("after"), F.col("low").alias("_low"))
    return b.join(a, key).select(key, "before", "after", (F.col("after") - F.col("before")).alias("change"), (F.col("_low") > F.col("_high")).alias("apart"))
