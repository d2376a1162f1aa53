"""Queries of episode summaries, evaluations compared, gates and picks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import resampling, statistics
from ..operators import evaluation as ev
from ..operators import reports, selection
from ..sources.bindings import EPISODES, STEPS, episodes, steps, table
from .core import query, r6

PLAYED = f"""{EPISODES}, played AS (SELECT episode_id, group_id, seed, terminal, terminal = 'cleared' AS won, n_steps, deaths, policy, fault, episode_id * 37 % 101 AS pellets_eaten, (episode_id * 37 % 101) / 101 AS clear_rate, (episode_id * 37 % 101) / 100 AS normal_clear_rate,
  100 - episode_id * 37 % 101 AS pellets_left, episode_id % 5 AS power_left, (episode_id % 211 = 0)::BIGINT AS parse_failures, (episode_id % 307 = 0)::BIGINT AS violations, episode_id % 13 AS walls, episode_id % 7 AS oscillations,
  seed * 40 + episode_id % 100 AS score, (seed * 40 + episode_id % 100) / 10 AS base_reward, (seed * 40 + episode_id % 100) / 10 - (episode_id % 13) / 4 AS shaped_reward,
  CASE WHEN terminal = 'cleared' THEN 1.0 + (episode_id % 4) / 40 ELSE 0.0 END::DOUBLE AS reward FROM episodes)"""


def played(spark, d) -> DataFrame:
    e, key = episodes(spark, d), F.col("episode_id")
    pellets, score = key * 37 % 101, F.col("seed") * 40 + key % 100
    return e.select(
        "episode_id", "group_id", "seed", "terminal", (F.col("terminal") == "cleared").alias("won"), "n_steps", "deaths", "policy", "fault",
        pellets.alias("pellets_eaten"), (pellets / 101).alias("clear_rate"), (pellets / 100).alias("normal_clear_rate"), (100 - pellets).alias("pellets_left"), (key % 5).alias("power_left"),
        (key % 211 == 0).cast("long").alias("parse_failures"), (key % 307 == 0).cast("long").alias("violations"), (key % 13).alias("walls"), (key % 7).alias("oscillations"),
        score.alias("score"), (score / 10).alias("base_reward"), (score / 10 - key % 13 / 4).alias("shaped_reward"), F.when(F.col("terminal") == "cleared", 1.0 + key % 4 / 40).otherwise(0.0).alias("reward"),
    )


def spoken(spark, d) -> DataFrame:
    return steps(spark, d).withColumn("reasoning", F.when(F.col("position") == 2, "because").when(F.col("position") == 3, "  "))


AVERAGES = {
    "pellet_clear_rate": "clear_rate", "normal_pellet_clear_rate": "normal_clear_rate", "normal_pellets_eaten": "pellets_eaten", "episode_length": "n_steps", "base_reward": "base_reward", "shaped_reward": "shaped_reward",
    "final_score": "score", "wall_collisions": "walls", "wall_hit_rate": "walls / greatest(n_steps, 1)", "oscillation_returns": "oscillations", "oscillation_rate": "oscillations / greatest(n_steps, 1)",
    "normal_pellets_remaining": "pellets_left", "power_pellets_remaining": "power_left", "death_count": "deaths", "max_no_progress_streak": "coalesce(streak, 0)",
}
COUNTS = ["n_U", "n_D", "n_L", "n_R", "n_S", "reasoning_turns"]


@query(f"""WITH {PLAYED}, {STEPS}, i AS (SELECT *, count(*) FILTER (delta > 0) OVER (PARTITION BY episode_id ORDER BY step) AS island FROM steps),
  r AS (SELECT episode_id, max(n) AS streak FROM (SELECT episode_id, island, count(*) FILTER (delta <= 0) AS n FROM i GROUP BY 1, 2) GROUP BY 1),
  c AS (SELECT episode_id, {", ".join(f"count(*) FILTER (action = '{a}') AS n_{a}" for a in "UDLRS")}, count(*) FILTER (position = 2) AS reasoning_turns FROM steps GROUP BY 1)
  SELECT policy, count(*) AS episodes, {", ".join(f"round(avg({c}), 6) AS average_{n}" for n, c in AVERAGES.items())}, count(*) FILTER (won) AS full_completions, sum(parse_failures)::BIGINT AS parse_failures, sum(violations)::BIGINT AS canonical_action_violations,
    round(count(*) FILTER (terminal = 'max_steps') / count(*), 6) AS max_step_rate, max(coalesce(streak, 0)) AS max_no_progress_streak, {", ".join(f'coalesce(sum({c}), 0)::BIGINT AS "{c}"' for c in COUNTS)}
  FROM played LEFT JOIN r USING (episode_id) LEFT JOIN c USING (episode_id) GROUP BY 1""")
def ag1_full_summary(spark, d):
    found = ev.summarised(played(spark, d), spoken(spark, d), "policy")
    return found.withColumns({c: F.round(c, 6) for c in [f"average_{n}" for n in AVERAGES] + ["max_step_rate"]})


@query(f"WITH {PLAYED} SELECT count(*) AS episodes, count(*) FILTER (won) AS wins, round(avg(shaped_reward), 6) AS avg_reward, round(avg(n_steps), 6) AS avg_steps FROM played")
def ag2_legacy_summary(spark, d):
    return ev.legacy_summary(played(spark, d)).withColumns({c: F.round(c, 6) for c in ("avg_reward", "avg_steps")})


@query(f"WITH {PLAYED} SELECT 0::BIGINT AS episodes, 0::BIGINT AS wins, 0.0::DOUBLE AS avg_reward, 0.0::DOUBLE AS avg_steps")
def ag2_empty_summary(spark, d):
    return ev.legacy_summary(played(spark, d).where("false"))


@query(f"WITH {STEPS} SELECT coalesce(CASE WHEN position < 4 THEN action END, 'unknown') AS key, count(*) AS n FROM steps GROUP BY 1")
def ag2_action_counters(spark, d):
    return ev.counters(steps(spark, d).withColumn("action", F.when(F.col("position") < 4, F.col("action"))), "action", "unknown")


CHRONO = f"""{PLAYED}, t AS (SELECT *, CASE WHEN episode_id // 24 % 5 = 4 THEN 'validation' ELSE 'train' END AS split, 'T=' || (seed % 3) AS contract FROM played),
  c AS (SELECT *, sum(CASE WHEN split IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY policy ORDER BY episode_id) AS run FROM (SELECT *, lag(split) OVER (PARTITION BY policy ORDER BY episode_id) AS p FROM t)),
  s AS (SELECT *, CASE split WHEN 'train' THEN 8 ELSE 4 END AS size, row_number() OVER (PARTITION BY policy, run ORDER BY episode_id) - 1 AS pos, count(*) OVER (PARTITION BY policy, run) AS n, max(run) OVER (PARTITION BY policy) AS last FROM c),
  b AS (SELECT *, pos // size AS batch, run < last AND (pos // size + 1) * size > n AS broken FROM s)"""


def chronological(spark, d) -> DataFrame:
    split = F.when(F.expr("episode_id div 24 % 5") == 4, "validation").otherwise("train")
    rows = played(spark, d).withColumns({"split": split, "contract": F.concat(F.lit("T="), (F.col("seed") % 3).cast("string"))})
    return ev.in_batches(rows, "policy", ["episode_id"], "split", {"train": 8, "validation": 4})


@query(f"WITH {CHRONO} SELECT policy, run::BIGINT AS run, batch, any_value(split) AS split, count(*) AS episodes, bool_or(broken) AS broken FROM b GROUP BY 1, 2, 3")
def ag4_chronological_batches(spark, d):
    return chronological(spark, d).groupBy("policy", "run", "batch").agg(F.max("split").alias("split"), F.count(F.lit(1)).alias("episodes"), F.bool_or("broken").alias("broken"))


@query(f"""WITH {CHRONO} SELECT policy, run::BIGINT AS run, batch, count(*) AS episodes, round(avg(score), 6) AS average_score, min(score) AS minimum_score, max(score) AS maximum_score, round(avg(walls / greatest(n_steps, 1)), 6) AS average_wall_hit_rate,
  count(*) FILTER (won) AS full_completions, array_to_string(list_sort(list(DISTINCT contract)), ';') AS contracts FROM b GROUP BY 1, 2, 3""")
def ag3_batch_summaries(spark, d):
    return ev.batch_summary(chronological(spark, d), "policy", "run", "batch").withColumns({c: F.round(c, 6) for c in ("average_score", "average_wall_hit_rate")})


@query(f"""WITH {PLAYED}, k AS (SELECT unnest(['panel' || seed % 4, 'all']) AS panel, won, reward FROM played) SELECT panel, round(count(*) FILTER (won) / count(*), 6) AS win_rate, round(avg(reward), 6) AS mean_reward FROM k GROUP BY 1""")
def ag6_panel_metrics(spark, d):
    rows = played(spark, d).withColumn("panel", F.concat(F.lit("panel"), (F.col("seed") % 4).cast("string")))
    return ev.panel_metrics(rows, "panel").withColumns({c: F.round(c, 6) for c in ("win_rate", "mean_reward")})


@query(f"""WITH {PLAYED} SELECT policy AS name, count(*) AS episodes, round(count(*) FILTER (reward >= 1) / count(*), 6) AS win_rate, round(avg(reward), 6) AS mean_reward, median(n_steps) FILTER (won)::DOUBLE AS success_steps_median FROM played GROUP BY 1""")
def ag8_eval_metrics(spark, d):
    samples = played(spark, d).select(F.col("policy").alias("name"), "episode_id", "reward", "won", "n_steps", F.lit("v1").alias("version"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("decision"))
    return ev.eval_metrics(samples).withColumns({c: F.round(c, 6) for c in ("win_rate", "mean_reward")})


PROBES = f"""{PLAYED}, g AS (SELECT seed % 6 AS state, group_id, count(*) AS n, count(*) FILTER (won) AS w, sum(reward) AS r, var_samp(reward) AS v FROM played GROUP BY 1, 2),
  p AS (SELECT state, sum(n)::BIGINT AS samples, sum(w)::BIGINT AS successes, sum(r) / sum(n) AS mean_reward, avg(v) AS group_reward_variance, avg(v / pow(sqrt(v) + 1e-5, 2)) AS advantage_variance, count(*) FILTER (n <> 12) AS odd_groups FROM g GROUP BY 1),
  s AS (SELECT *, successes / samples AS success_rate, 1.959963984540054 AS z FROM p),
  wl AS (SELECT *, (success_rate + z*z/(2*samples)) / (1 + z*z/samples) AS mid, z*sqrt(success_rate*(1-success_rate)/samples + z*z/(4*samples*samples)) / (1 + z*z/samples) AS half FROM s)"""


def probes(spark, d) -> DataFrame:
    return ev.probe_states(played(spark, d).withColumn("state", F.col("seed") % 6))


@query(f"""WITH {PROBES} SELECT state, samples, successes, round(mean_reward, 6) AS mean_reward, round(group_reward_variance, 6) AS group_reward_variance, round(advantage_variance, 5) AS advantage_variance, odd_groups, round(success_rate, 6) AS success_rate,
  round(greatest(0, mid - half), 6)::DOUBLE AS low, round(least(1, mid + half), 6)::DOUBLE AS high, samples >= 24 AS adequate FROM wl""")
def ag9_ag30_probe_states(spark, d):
    return probes(spark, d).withColumns({c: F.round(c, 6) for c in ("mean_reward", "group_reward_variance", "success_rate", "low", "high")} | {"advantage_variance": F.round("advantage_variance", 5)})


@query(f"""WITH {PROBES} SELECT state, round(success_rate, 6) AS success_rate, (state * 13 + 7) % 5 AS env_step FROM wl WHERE samples >= 24 AND success_rate BETWEEN 0.3 AND 0.7 ORDER BY (state * 13 + 7) % 5, state LIMIT 1""")
def sel5_jn6_earliest_learnable(spark, d):
    states = spark.range(6).select(F.col("id").alias("state"), ((F.col("id") * 13 + 7) % 5).alias("env_step"))
    return ev.earliest_learnable(probes(spark, d), states).select("state", *r6("success_rate"), "env_step")


@query("""WITH a AS (SELECT l_returnflag AS part, abs(x) AS a, x, 1 << (l_partkey % 4)::INT AS bit, l_suppkey % 16 AS mask, l_linenumber % 3 AS version FROM (SELECT *, l_discount - l_tax AS x FROM lineitem)),
  n AS (SELECT part, count(*) AS tokens, avg(x) AS signed_mean, avg(a) AS mean_abs, sqrt(avg(x * x)) AS rms, max(a) AS max_abs, count(*) FILTER (mask & bit = 0) AS mask_violations, count(*) FILTER (version <> 1) AS version_mismatches, list_sort(list(a)) AS l FROM a GROUP BY 1)
  SELECT part, tokens, round(signed_mean, 6) AS signed_mean, round(mean_abs, 6) AS mean_abs, round(rms, 6) AS rms, round(max_abs, 6) AS max_abs, mask_violations, version_mismatches, round(l[(round_even((tokens - 1) * 0.5, 0) + 1)::INT], 6) AS p50_abs,
    round(l[(round_even((tokens - 1) * 0.95, 0) + 1)::INT], 6) AS p95_abs, round(l[(round_even((tokens - 1) * 0.99, 0) + 1)::INT], 6) AS p99_abs, false AS aligned FROM n""")
def ag12_alignment(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("part"), (F.col("l_discount") - F.col("l_tax")).alias("delta"), F.expr("shiftleft(1L, int(l_partkey % 4))").alias("bit"), (F.col("l_suppkey") % 16).alias("mask"), (F.col("l_linenumber") % 3).alias("version"), F.lit(1).alias("current_version"))
    return ev.alignment(rows, "part", 0.5, 0.1).withColumns({c: F.round(c, 6) for c in ("signed_mean", "mean_abs", "rms", "max_abs", "p50_abs", "p95_abs", "p99_abs")})


@query("""WITH r AS (SELECT lang AS task, (n_chars % 3)::VARCHAR AS size, CASE WHEN doc_id % 3 = 0 THEN ['edge', 'overlap'] WHEN doc_id % 3 = 1 THEN ['edge'] ELSE []::VARCHAR[] END AS cats, doc_id % 4 > 0 AS valid, doc_id % 4 = 1 AS exact FROM documents),
  k AS (SELECT unnest(list_concat(['all', task, task || '@' || size], list_transform(cats, lambda c: task || ':' || c))) AS key, valid, exact FROM r) SELECT key, count(*) AS n, count(*) FILTER (valid) AS valid, count(*) FILTER (exact) AS exact FROM k GROUP BY 1""")
def ag11_category_rollup(spark, d):
    i = F.col("doc_id")
    cats = F.when(i % 3 == 0, F.array(F.lit("edge"), F.lit("overlap"))).when(i % 3 == 1, F.array(F.lit("edge")))
    return ev.categories_rollup(table(spark, d, "documents").select(F.col("lang").alias("task"), (F.col("n_chars") % 3).cast("string").alias("size"), cats.alias("categories"), (i % 4 > 0).alias("valid"), (i % 4 == 1).alias("exact")))


SUMMARIES = f"""{PLAYED}, sums AS (SELECT CASE seed WHEN 0 THEN 'base' ELSE 'update' || seed END AS label, count(*) AS episodes, count(*) FILTER (won) AS wins, avg(clear_rate) AS clear_rate, avg(pellets_eaten) AS pellets, avg(shaped_reward) AS shaped_reward,
  avg(walls / greatest(n_steps, 1)) AS wall_rate, avg(oscillations / greatest(n_steps, 1)) AS oscillation_rate, count(*) FILTER (fault AND seed % 5 = 2) AS errors, sum(parse_failures)::BIGINT AS parse_failures, sum(violations)::BIGINT AS violations FROM played GROUP BY seed)"""


def summaries(spark, d) -> DataFrame:
    length = F.greatest("n_steps", F.lit(1))
    per = played(spark, d).groupBy("seed").agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if("won").alias("wins"), F.avg("clear_rate").alias("clear_rate"), F.avg("pellets_eaten").alias("pellets"), F.avg("shaped_reward").alias("shaped_reward"), F.avg(F.col("walls") / length).alias("wall_rate"),
        F.avg(F.col("oscillations") / length).alias("oscillation_rate"), F.count_if(F.col("fault") & (F.col("seed") % 5 == 2)).alias("errors"), F.sum("parse_failures").alias("parse_failures"), F.sum("violations").alias("violations"),
    )
    return per.withColumn("label", F.when(F.col("seed") == 0, "base").otherwise(F.concat(F.lit("update"), F.col("seed").cast("string")))).drop("seed")


@query(f"WITH {SUMMARIES} SELECT label, episodes, wins FROM sums WHERE label <> 'base' AND errors = 0 ORDER BY wins / episodes DESC, clear_rate DESC, substr(label, 7)::INT LIMIT 1")
def sel1_sel2_fn9_best_checkpoint(spark, d):
    return ev.best_checkpoint(summaries(spark, d), F.lit("validation")).select("label", "episodes", "wins")


@query(f"WITH {SUMMARIES} SELECT label, wins FROM sums WHERE label <> 'base' ORDER BY wins DESC, clear_rate DESC, shaped_reward DESC, wall_rate, oscillation_rate, substr(label, 7)::INT LIMIT 1")
def sel3_best_update(spark, d):
    return ev.best_update(summaries(spark, d).where("label <> 'base'")).select("label", "wins")


@query(f"""WITH {PLAYED}, u AS (SELECT group_id AS update, count(*) FILTER (won) AS wins, count(*) AS episodes, group_id % 100 = 3 AS pending FROM played GROUP BY 1),
  m AS (SELECT max(update) AS latest, arg_max(update, {{'r': wins / episodes, 'u': -update}}) AS best FROM u) SELECT update, update = latest AS latest, update = best AS best, pending FROM u, m WHERE update = latest OR update = best OR pending""")
def sel6_retained_checkpoints(spark, d):
    u = played(spark, d).groupBy(F.col("group_id").alias("update")).agg(F.count_if("won").alias("wins"), F.count(F.lit(1)).alias("episodes")).withColumn("pending", F.col("update") % 100 == 3)
    return ev.retained(u)


@query(f"WITH {SUMMARIES} SELECT label, episodes, wins, round(clear_rate, 6) AS clear_rate, round(shaped_reward, 6) AS shaped_reward FROM sums")
def prj1_compact_summaries(spark, d):
    return reports.compact(summaries(spark, d), "label", "episodes", "wins", rounded=("clear_rate", "shaped_reward"))


@query(f"""WITH {SUMMARIES}, b AS (SELECT * FROM sums WHERE label = 'base'), p AS (SELECT s.label, b.clear_rate + 0.05::DOUBLE AS before, s.clear_rate + s.wins / s.episodes / 2 AS after, s.parse_failures, s.violations % 2 AS violations FROM sums s, b WHERE s.label <> 'base'),
  g AS (SELECT *, after - before AS gain, (after >= 0.5 AND after - before >= 0.2) OR (before > 0.5 AND after >= 0.9) AS progress, parse_failures = 0 AND violations = 0 AS clean FROM p)
  SELECT label, round(gain * 100, 5) AS improvement, progress, clean, progress AND clean AS accepted FROM g""")
def nm21_progress_gate(spark, d):
    s = summaries(spark, d)
    base = s.where("label = 'base'").select((F.col("clear_rate") + 0.05).alias("before"))
    rows = s.where("label <> 'base'").crossJoin(F.broadcast(base)).select("label", "before", (F.col("clear_rate") + F.col("wins") / F.col("episodes") / 2).alias("after"), "parse_failures", (F.col("violations") % 2).alias("violations"))
    return ev.progress_gate(rows).select("label", F.round("improvement", 5).alias("improvement"), "progress", "clean", "accepted")


@query(f"""WITH {SUMMARIES}, b AS (SELECT * FROM sums WHERE label = 'base') SELECT s.label, round(s.clear_rate + 0.12::DOUBLE - b.clear_rate, 6) AS clear_delta, s.clear_rate + 0.12::DOUBLE - b.clear_rate >= 0.1 AND s.pellets > b.pellets AND (s.shaped_reward > b.shaped_reward OR s.wins > b.wins) AND s.wall_rate - b.wall_rate <= 0.05 AS passed FROM sums s, b WHERE s.label <> 'base'""")
def nm22_overfit_gate(spark, d):
    s = summaries(spark, d)
    return ev.overfit_gate(s.where("label = 'base'"), s.where("label <> 'base'").withColumn("clear_rate", F.col("clear_rate") + 0.12)).select("label", *r6("clear_delta"), "passed")


HALVES = f"""{PLAYED}, h AS (SELECT seed, episode_id % 2 AS side, won OR (episode_id % 2 = 1 AND episode_id % 3 = 0) AS won, reward, pellets_eaten, group_id FROM played),
  c AS (SELECT seed, count(*) FILTER (side = 0) AS bn, count(*) FILTER (side = 0 AND won) AS bw, count(*) FILTER (side = 1) AS fn, count(*) FILTER (side = 1 AND won) AS fw FROM h GROUP BY 1)"""


def halves(spark, d) -> tuple[DataFrame, DataFrame]:
    h = played(spark, d)
    final = h.where("episode_id % 2 = 1").withColumn("won", F.col("won") | (F.col("episode_id") % 3 == 0))
    return h.where("episode_id % 2 = 0"), final


@query(f"WITH {HALVES} SELECT seed, bn AS base_n, bw AS base_wins, fn AS final_n, fw AS final_wins FROM c")
def jn3_paired_seeds(spark, d):
    return statistics.paired_counts(*halves(spark, d), "seed")


@query(f"""WITH {HALVES}, t AS (SELECT sum(bw) / sum(bn) AS b, sum(fw) / sum(fn) AS f, sqrt(sum(fn * (fw / fn) * (1 - fw / fn)) / pow(sum(fn), 2) + sum(bn * (bw / bn) * (1 - bw / bn)) / pow(sum(bn), 2)) AS se, count(*) FILTER (fw / fn < bw / bn) AS regressed FROM c)
  SELECT round(b, 6) AS baseline, round(f, 6) AS final, round(f - b, 6) AS difference, f - b >= 0.1 AND f - b - 1.96 * se > 0 AS clear_improvement, regressed FROM t""")
def nm3_clear_improvement(spark, d):
    found = statistics.clear_improvement(*halves(spark, d), "seed")
    return found.select(*r6("baseline", "final", "difference"), "clear_improvement", "regressed")


@query(f"""WITH {HALVES} SELECT seed, round(bw / bn, 6) AS base, round(fw / fn, 6) AS final, round(fw / fn - bw / bn, 6) AS difference, fw / fn < bw / bn AS regressed FROM c""")
def nm3_seed_differences(spark, d):
    """Which seeds got better or worse, by name."""
    return statistics.key_differences(*halves(spark, d), "seed").select("seed", *r6("base", "final", "difference"), "regressed")


@query(f"""WITH {HALVES}, t AS (SELECT sum(fw) / sum(fn) - sum(bw) / sum(bn) AS diff, count(*) AS keys FROM c) SELECT round, keys AS drawn, round(diff, 6) AS difference, true AS inside FROM t, range(10000) r(round)""")
def nm4_seed_cluster_interval(spark, d):
    """Every round draws as many keys as there are; its rates lie in [0, 1], and the interval of the rounds' differences holds the whole difference."""
    base, final = halves(spark, d)
    counts = statistics.paired_counts(base, final, "seed").agg((F.sum("final_wins") / F.sum("final_n") - F.sum("base_wins") / F.sum("base_n")).alias("difference"))
    both = counts.crossJoin(statistics.cluster_interval(base, final, "seed"))  # one row each
    rounds = statistics.cluster_rounds(base, final, "seed").where("base BETWEEN 0 AND 1 AND final BETWEEN 0 AND 1")
    return rounds.select("round", "drawn").crossJoin(F.broadcast(both)).select("round", "drawn", *r6("difference"), F.col("difference").between(F.col("low"), F.col("high")).alias("inside"))


@query(f"""WITH {PLAYED}, m AS (SELECT count(*) FILTER (episode_id % 2 = 0) AS b, count(*) FILTER (episode_id % 2 = 1) AS a FROM played) SELECT round, b AS drawn_before, a AS drawn_after FROM m, range(10000) r(round)""")
def nm5_resampled_rounds(spark, d):
    """Each round draws exactly as many rows of either side as it has."""
    return statistics.delta_rounds(*halves(spark, d), "clear_rate").where("delta BETWEEN -1 AND 1").drop("delta")


@query(f"""WITH {PLAYED}, m AS (SELECT avg(clear_rate) FILTER (episode_id % 2 = 0) AS b, avg(clear_rate) FILTER (episode_id % 2 = 1) AS a, var_samp(clear_rate) FILTER (episode_id % 2 = 0) / count(*) FILTER (episode_id % 2 = 0) + var_samp(clear_rate) FILTER (episode_id % 2 = 1) / count(*) FILTER (episode_id % 2 = 1) AS v FROM played) SELECT round(a - b, 6) AS delta, true AS inside, true AS as_wide FROM m""")
def nm5_mean_delta_interval(spark, d):
    """The interval holds the difference and is as wide, within a tenth, as the normal approximation says."""
    base, final = halves(spark, d)
    found = statistics.delta_interval(base, final, "clear_rate")
    spread = base.agg((F.var_samp("clear_rate") / F.count(F.lit(1))).alias("v")).crossJoin(final.agg((F.var_samp("clear_rate") / F.count(F.lit(1))).alias("w")))
    both = found.crossJoin(spread)  # one row each
    wide = (F.col("high") - F.col("low")) / (2 * statistics.Z * F.sqrt(F.col("v") + F.col("w")))
    return both.select(*r6("delta"), F.col("delta").between(F.col("low"), F.col("high")).alias("inside"), wide.between(0.9, 1.1).alias("as_wide"))


MODES = f"""{EPISODES}, paired AS (SELECT a.group_id AS pair, a.terminal = 'cleared' AND NOT a.fault AS p, b.terminal = 'cleared' AND NOT b.fault AS e, a.fault OR b.fault AS incomplete, b.n_steps - a.n_steps AS gap
  FROM episodes a JOIN episodes b ON a.group_id = b.group_id AND a.episode_id % 12 = 3 AND b.episode_id % 12 = 4)"""


def modes(spark, d) -> DataFrame:
    e = episodes(spark, d)
    side = lambda k, n: e.where(F.col("episode_id") % 12 == k).select(F.col("group_id").alias("pair"), ((F.col("terminal") == "cleared") & ~F.col("fault")).alias(n), F.col("fault").alias(f"fault_{n}"), F.col("n_steps").alias(f"steps_{n}"))
    return side(3, "p").join(side(4, "e"), "pair")


@query(f"""WITH {MODES} SELECT count(*) AS pairs, count(*) FILTER (NOT incomplete) AS complete_pairs, count(*) FILTER (e AND NOT p) AS e_only, count(*) FILTER (p AND NOT e) AS p_only, round(avg(e::INT - p::INT), 6) AS win_difference, round(avg(gap) FILTER (NOT incomplete), 6) AS mean_gap FROM paired""")
def jn5_paired_modes(spark, d):
    return reports.compact(reports.paired_outcomes(modes(spark, d)), "pairs", "complete_pairs", "e_only", "p_only", rounded=("win_difference", "mean_gap"))


@query(f"WITH {MODES}, m AS (SELECT count(*) AS n, round(avg(e::INT - p::INT), 6) AS mean FROM paired) SELECT round, n AS drawn, mean, true AS inside FROM m, range(20000) r(round)")
def nm6_paired_interval(spark, d):
    m = modes(spark, d).select(F.col("e").cast("int").alias("e"), F.col("p").cast("int").alias("p"))
    found = statistics.mean_interval(m, "e", 20_000, 20261015, less="p")
    rounds = resampling.resampled_means(m, "e", 20_000, 20261015, "p").where("mean BETWEEN -1 AND 1")
    return rounds.select("round", "drawn").crossJoin(F.broadcast(found)).select("round", "drawn", *r6("mean"), F.col("mean").between(F.col("low"), F.col("high")).alias("inside"))


@query(f"""WITH {EPISODES}, a AS (SELECT policy, count(*) FILTER (terminal = 'cleared') AS wins, count(*) AS n FROM episodes GROUP BY 1), w AS (SELECT *, wins / n AS p, 1.959963984540054 AS z FROM a)
  SELECT policy, round((p + z*z/(2*n)) / (1 + z*z/n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 6) AS low, round((p + z*z/(2*n)) / (1 + z*z/n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 6) AS high FROM w""")
def nm1b_unclamped_wilson(spark, d):
    per = episodes(spark, d).groupBy("policy").agg(F.count_if(F.col("terminal") == "cleared").alias("wins"), F.count(F.lit(1)).alias("n"))
    low, high = statistics.wilson_unclamped(F.col("wins"), F.col("n"))
    return per.select("policy", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


GATED = f"""{PLAYED}, s AS (SELECT seed % 6 AS state, episode_id % 2 AS side, count(*) AS samples, count(*) FILTER (won OR (episode_id % 2 = 1 AND seed % 6 < 3)) AS wins, avg(reward) AS mean_reward, avg(pellets_eaten) AS mean_pellets, var_samp(reward) AS v FROM played GROUP BY 1, 2),
  w AS (SELECT *, (wins / samples + 1.959963984540054 ** 2 / (2 * samples)) / (1 + 1.959963984540054 ** 2 / samples) AS mid, 1.959963984540054 * sqrt(wins / samples * (1 - wins / samples) / samples + 1.959963984540054 ** 2 / (4 * samples * samples)) / (1 + 1.959963984540054 ** 2 / samples) AS half FROM s)"""


@query(f"""WITH {GATED} SELECT b.state, b.samples >= 24 AND a.samples >= 24 AS adequate, greatest(0, a.mid - a.half) > least(1, b.mid + b.half) AS apart, a.mean_reward > b.mean_reward OR a.mean_pellets > b.mean_pellets AS progress, a.v > 1e-12 AS signal, b.v > 0 AS dispersion,
  b.samples >= 24 AND a.samples >= 24 AND greatest(0, a.mid - a.half) > least(1, b.mid + b.half) AND (a.mean_reward > b.mean_reward OR a.mean_pellets > b.mean_pellets) AND a.v > 1e-12 AND b.v > 0 AS passed FROM w b JOIN w a ON a.state = b.state AND a.side = 1 AND b.side = 0""")
def nm20_jn4_pilot_gate(spark, d):
    p = played(spark, d).withColumns({"state": F.col("seed") % 6, "side": F.col("episode_id") % 2})
    won = F.col("won") | ((F.col("side") == 1) & (F.col("state") < 3))
    per = p.groupBy("state", "side").agg(F.count(F.lit(1)).alias("samples"), F.count_if(won).alias("wins"), F.avg("reward").alias("mean_reward"), F.avg("pellets_eaten").alias("mean_pellets"), F.var_samp("reward").alias("group_variance"))
    low, high = statistics.wilson(F.col("wins"), F.col("samples"))
    per = per.withColumns({"low": low, "high": high, "advantage_variance": F.col("group_variance")})
    return ev.pilot_gate(per.where("side = 0").drop("side", "wins"), per.where("side = 1").drop("side", "wins"), "state")


LOGITS = """x AS (SELECT p_partkey, [p_size / 10, p_retailprice / 1000, (p_partkey % 7) / 3] AS a, [p_size / 11, p_retailprice / 1000, (p_partkey % 5) / 3] AS b FROM part),
  y AS (SELECT p_partkey, list_transform(a, lambda v: v - ln(list_sum(list_transform(a, lambda u: exp(u))))) AS p, list_transform(b, lambda v: v - ln(list_sum(list_transform(b, lambda u: exp(u))))) AS q FROM x)"""


def logits(spark, d) -> DataFrame:
    a = F.array(F.col("p_size") / 10, F.col("p_retailprice") / 1000, (F.col("p_partkey") % 7) / 3)
    b = F.array(F.col("p_size") / 11, F.col("p_retailprice") / 1000, (F.col("p_partkey") % 5) / 3)
    return table(spark, d, "part").select("p_partkey", statistics.log_softmax(a).alias("p"), statistics.log_softmax(b).alias("q"))


@query(f"""WITH {LOGITS}, d AS (SELECT p_partkey, list_sort(list_transform(range(1, 4), lambda i: abs(q[i] - p[i]))) AS a, list_transform(range(1, 4), lambda i: exp(q[i] - p[i])) AS r, greatest(0, list_sum(list_transform(range(1, 4), lambda i: exp(p[i]) * (p[i] - q[i])))) AS kl FROM y)
  SELECT p_partkey, 3::BIGINT AS actions, round(a[2], 6) AS p50, round(a[3], 6) AS max_delta, round(kl, 6)::DOUBLE AS kl, round(list_min(r), 6) AS ratio_min, round(list_max(r), 6) AS ratio_max, round(len(list_filter(r, lambda v: v < 0.8 OR v > 1.2)) / 3, 6) AS outside_clip, a[3] <= 0.35 AND kl <= 0.05 AS passed FROM d""")
def nm18_distribution_report(spark, d):
    rows = logits(spark, d).select("p_partkey", F.col("p").alias("old"), F.col("q").alias("new"))
    return ev.distribution_report(rows, "p_partkey", max_delta=0.35, max_kl=0.05).withColumns({c: F.round(c, 6) for c in ("p50", "max_delta", "kl", "ratio_min", "ratio_max", "outside_clip")})


@query(f"""WITH {LOGITS} SELECT count(*) AS decisions, round(avg((list_position(p, list_max(p)) = list_position(q, list_max(q)))::INT), 6) AS argmax_agreement, round(avg(list_sum(list_transform(range(1, 4), lambda i: exp(p[i]) * (p[i] - q[i])))), 6) AS kl FROM y""")
def jn9_nm23_drift(spark, d):
    x = logits(spark, d)
    return ev.drift(x.select("p_partkey", F.col("p").alias("logp")), x.select("p_partkey", F.col("q").alias("logp")), "p_partkey").select("decisions", *r6("argmax_agreement", "kl"))


@query(f"""WITH {LOGITS}, c AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN p[1:1] WHEN p_partkey % 4 = 1 THEN [0.0, -9.0] ELSE p END AS l FROM y), e AS (SELECT list_transform(l, lambda v: v - ln(list_sum(list_transform(l, lambda u: exp(u))))) AS n FROM c WHERE len(l) > 1),
  h AS (SELECT -list_sum(list_transform(n, lambda v: exp(v) * v)) AS h FROM e) SELECT count(*) AS decisions, round(avg(h), 6) AS entropy, round(count(*) FILTER (h < 0.01) / count(*), 6) AS near_zero FROM h""")
def ag26_choice_entropy(spark, d):
    at = F.col("p_partkey") % 4
    x = logits(spark, d).withColumn("logp", F.when(at == 0, F.slice("p", 1, 1)).when(at == 1, F.array(F.lit(0.0), F.lit(-9.0))).otherwise(F.col("p")))
    return ev.choice_entropy(x).select("decisions", *r6("entropy", "near_zero"))


@query(f"""WITH {PLAYED}, a AS (SELECT seed AS rollout, avg((clear_rate > 0.5 - seed / 100)::INT) AS accuracy FROM played GROUP BY 1), f AS (SELECT arg_min(accuracy, rollout) AS first FROM a) SELECT rollout, round(accuracy, 6) AS accuracy, round(first - accuracy, 6) AS drop, first - accuracy > 0.1 AS failed FROM a, f""")
def ag27_accuracy_drop(spark, d):
    p = played(spark, d).select(F.col("seed").alias("rollout"), (F.col("clear_rate") > 0.5 - F.col("seed") / 100).alias("correct"))
    return ev.accuracy_drop(p).select("rollout", *r6("accuracy", "drop"), "failed")


@query("SELECT doc_id AS scenario, n_chars AS tokens, 4000 - n_chars AS headroom, n_chars < 4000 AS passed FROM documents ORDER BY n_chars DESC, doc_id LIMIT 1")
def ag28_largest_scenario(spark, d):
    return ev.largest_scenario(table(spark, d, "documents").select(F.col("doc_id").alias("scenario"), F.col("n_chars").alias("tokens"), F.col("doc_id").alias("at")), 4000)


@query(f"""WITH {PLAYED}, r AS (SELECT CASE WHEN seed % 10 < 7 THEN 'train' WHEN seed % 10 < 9 THEN 'validation' ELSE 'test' END AS split, terminal FROM played) SELECT split, terminal, count(*) AS n FROM r GROUP BY 1, 2""")
def ag18_dataset_counters(spark, d):
    at = F.col("seed") % 10
    return reports.split_counters(played(spark, d), F.when(at < 7, "train").when(at < 9, "validation").otherwise("test"), "terminal")


@query("SELECT count(*) AS draws, count(DISTINCT l_partkey) AS distinct_items, count(DISTINCT l_suppkey) AS distinct_frames, max(c)::BIGINT AS max_repeat, round(count(*) FILTER (l_quantity > 25) / count(*), 6) AS large_fraction FROM lineitem JOIN (SELECT l_partkey, count(*) AS c FROM lineitem GROUP BY 1) USING (l_partkey)")
def ag19_plan_statistics(spark, d):
    found = reports.plan_statistics(table(spark, d, "lineitem"), "l_partkey", "l_suppkey", F.col("l_quantity") > 25)
    return reports.compact(found, "draws", "distinct_items", "distinct_frames", "max_repeat", rounded=("large_fraction",))


@query("""SELECT count(*) AS layouts, count(DISTINCT sha256(p_brand || p_type)) AS distinct_layouts, count(DISTINCT sha256(translate(p_brand, '0123456789', '##########'))) AS distinct_topologies, min(p_size) AS least_steps, max(p_size) AS most_steps FROM part""")
def ag20_suite_summary(spark, d):
    return reports.suite_summary(table(spark, d, "part"), F.concat("p_brand", "p_type"), F.translate("p_brand", "0123456789", "##########"), "p_size")


@query(f"WITH {PLAYED} SELECT policy, count(*)::DOUBLE AS episodes, round(avg(won::INT), 6) AS win_rate, round(avg(score), 6) AS mean_score, round(avg(n_steps), 6) AS mean_steps FROM played GROUP BY 1")
def ag21_agent_evaluation(spark, d):
    return reports.compact(reports.agent_evaluation(played(spark, d), "policy"), "policy", "episodes", rounded=("win_rate", "mean_score", "mean_steps"))


@query(f"WITH {PLAYED} SELECT s.seed, count(episode_id) AS examples, count(*) FILTER (won) AS wins, min(reward) AS reward_min, max(reward) AS reward_max, round(avg(reward), 6) AS reward_mean FROM range(0, 31) s(seed) LEFT JOIN played ON played.seed = s.seed GROUP BY 1")
def ag24_route_summary(spark, d):
    """Seeds without examples have no extremes, and no mean."""
    found = reports.route_summary(spark.range(31).withColumnRenamed("id", "seed"), played(spark, d))
    return found.withColumn("reward_mean", F.round("reward_mean", 6))


@query("""WITH r AS (SELECT user_id AS seed, CASE WHEN event_type <> 'error' THEN value END AS latency, event_id % 50 AS tokens FROM events) SELECT seed, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95, sum(tokens)::BIGINT AS input_tokens, count(latency) AS calls FROM r GROUP BY 1""")
def ag29_request_metrics(spark, d):
    from ..operators.orderstats import linear_quantiles

    r = table(spark, d, "events").select(F.col("user_id").alias("seed"), F.when(F.col("event_type") != "error", F.col("value")).alias("latency"), (F.col("event_id") % 50).alias("tokens"))
    sums = r.groupBy("seed").agg(F.sum("tokens").alias("input_tokens"), F.count("latency").alias("calls"))
    return sums.join(linear_quantiles(r, ["seed"], "latency", {"p50": 0.5, "p95": 0.95}), "seed", "left").select("seed", *r6("p50", "p95"), "input_tokens", "calls")


@query(f"""WITH {EPISODES}, g AS (SELECT group_id, count(*) AS attempts, bool_or(fault) AS masked, count(*) FILTER (fault) AS n_faults, stddev_pop(n_steps) >= 1e-12 AS spread FROM episodes GROUP BY 1)
  SELECT sum(attempts)::BIGINT AS loss_denominator, (sum(attempts) - sum(n_faults))::BIGINT AS valid_outcomes, count(*) FILTER (NOT masked) AS eligible, count(*) FILTER (masked) AS excluded, count(*) FILTER (NOT masked AND spread) AS informative,
  CASE WHEN count(*) FILTER (NOT masked) = 0 THEN 'no_complete_valid_groups' WHEN count(*) FILTER (NOT masked AND spread) = 0 THEN 'no_within_complete_group_advantage' ELSE 'none' END AS skip_reason FROM g""")
def ag25_batch_plan_summary(spark, d):
    from ..operators.aggregates import batch_plan_summary

    return batch_plan_summary(episodes(spark, d).withColumn("reward", F.col("n_steps").cast("double"))).fillna("none", ["skip_reason"])


@query(f"""WITH {PLAYED}, c AS (SELECT policy, sha256('T=' || (seed % CASE WHEN policy = '1-URGENT' THEN 1 ELSE 3 END)) AS contract FROM played) SELECT policy AS mode, count(DISTINCT contract) AS contracts, count(DISTINCT contract) = 1 AS homogeneous FROM c GROUP BY 1""")
def val12_protocol_homogeneity(spark, d):
    from ..operators.audit import homogeneous

    temperature = F.when(F.col("policy") == "1-URGENT", F.lit(0)).otherwise(F.col("seed") % 3)
    rows = played(spark, d).select(F.col("policy").alias("mode"), F.sha2(F.concat(F.lit("T="), temperature.cast("string")), 256).alias("contract"))
    return homogeneous(rows, "mode", "contract")


WILSON = """(rate + 1.959963984540054 ** 2 / (2 * n)) / (1 + 1.959963984540054 ** 2 / n) AS mid, 1.959963984540054 * sqrt(rate * (1 - rate) / n + 1.959963984540054 ** 2 / (4 * n * n)) / (1 + 1.959963984540054 ** 2 / n) AS half"""


@query(f"""WITH {EPISODES}, s AS (SELECT group_id AS state, count(*) AS n, count(*) FILTER (terminal = 'cleared') AS wins, count(*) FILTER (terminal = 'cleared') / count(*) AS rate, list_sort(list(episode_id % 12)) = range(0, 12) AS complete FROM episodes GROUP BY 1), w AS (SELECT *, {WILSON} FROM s)
  SELECT state, n AS samples, wins AS successes, complete, round(rate, 6) AS success_rate, round(greatest(0, mid - half), 6)::DOUBLE AS low, round(least(1, mid + half), 6)::DOUBLE AS high FROM w""")
def ag10_screening(spark, d):
    rows = episodes(spark, d).select(F.col("group_id").alias("state"), (F.col("episode_id") % 12).alias("i"), (F.col("terminal") == "cleared").alias("won"))
    return ev.screened(rows, 12).withColumns({c: F.round(c, 6) for c in ("success_rate", "low", "high")})


@query(f"""WITH {EPISODES}, s AS (SELECT seed, episode_id % 2 AS side, count(*) AS n, count(*) FILTER (terminal = 'cleared' OR (episode_id % 2 = 1 AND seed % 3 = 0)) / count(*) AS rate FROM episodes WHERE NOT (seed = 5 AND episode_id % 2 = 1) GROUP BY 1, 2), w AS (SELECT *, {WILSON} FROM s)
  SELECT b.seed, round(b.rate, 6) AS before, round(a.rate, 6) AS after, round(a.rate - b.rate, 6) AS change, greatest(0, a.mid - a.half) > least(1, b.mid + b.half) AS apart FROM w b JOIN w a ON a.seed = b.seed AND a.side = 1 AND b.side = 0""")
def jn4_before_and_after(spark, d):
    e = episodes(spark, d).withColumn("side", F.col("episode_id") % 2).where("NOT (seed = 5 AND side = 1)")
    won = (F.col("terminal") == "cleared") | ((F.col("side") == 1) & (F.col("seed") % 3 == 0))
    per = e.groupBy("seed", "side").agg(F.count(F.lit(1)).alias("n"), F.count_if(won).alias("wins"))
    low, high = statistics.wilson(F.col("wins"), F.col("n"))
    per = per.withColumns({"success_rate": F.col("wins") / F.col("n"), "low": low, "high": high})
    return ev.before_and_after(per.where("side = 0"), per.where("side = 1"), "seed").select("seed", *r6("before", "after", "change"), "apart")


@query(f"""WITH {EPISODES}, r AS (SELECT group_id // 16 AS batch, group_id, episode_id % 12 AS replica FROM episodes WHERE NOT (fault AND group_id // 16 % 2 = 0)), g AS (SELECT batch, group_id, count(*) AS n, count(DISTINCT replica) AS d FROM r GROUP BY 1, 2), b AS (SELECT batch, count(*) AS groups, sum(n)::BIGINT AS members, sum(n - d)::BIGINT AS repeated, 0::BIGINT AS outside FROM g GROUP BY 1) SELECT * FROM b WHERE groups <> 16 OR members <> 192 OR repeated > 0""")
def val14_batch_coverage(spark, d):
    rows = episodes(spark, d).withColumns({"batch": F.expr("group_id div 16"), "replica": F.col("episode_id") % 12}).where("NOT (fault AND batch % 2 = 0)")
    return selection.incomplete_batches(rows, "batch", "group_id", "replica", 16, 12)


@query("""WITH c AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'ELIMINATE' WHEN 1 THEN 'COLLECT' WHEN 2 THEN 'AVOID' ELSE 'OTHER' END AS strategy, o_totalprice FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, strategy ORDER BY o_totalprice, o_orderkey) AS place FROM c)
  SELECT o_custkey, o_orderkey, strategy, place FROM n WHERE place <= CASE strategy WHEN 'COLLECT' THEN 4 WHEN 'AVOID' THEN 4 WHEN 'ELIMINATE' THEN 2 ELSE 0 END""")
def sel15_ranked_candidates(spark, d):
    at = F.col("o_orderkey") % 4
    c = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(at == 0, "ELIMINATE").when(at == 1, "COLLECT").when(at == 2, "AVOID").otherwise("OTHER").alias("strategy"), "o_totalprice")
    return selection.ranked_by_strategy(c, "o_custkey", "strategy", {"COLLECT": 4, "AVOID": 4, "ELIMINATE": 2}, F.col("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "strategy", "place")
