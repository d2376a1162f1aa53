"""All registered queries of the engine and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar, statistics
from ..operators import aggregates, audit, ordered, orderstats, reports, selection
from ..sources import sinks
from ..sources.bindings import EPISODES, STEPS, episodes, steps, table
from ..streaming import controller
from . import audits, boards, evaluation, fields, files, flows  # noqa: F401  (registers its queries)
from .core import FLAGSHIP, ORACLE_SQL, QUERIES, REWARDS, TIE, query, r6, rewards

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]


# aggregates


@query(f"""WITH {STEPS} SELECT episode_id, count(*) AS steps, sum(delta)::BIGINT AS score, count(*) FILTER (delta > 0) AS gains,
  max_by(action, step) AS last_action, max_by(position, step) AS last_position FROM steps GROUP BY 1""")
def ag0_episode_headers(spark, d):
    return aggregates.episode_headers(steps(spark, d))


@query(f"""WITH {STEPS} SELECT count(*) FILTER (action='U') AS "n_U", count(*) FILTER (action='D') AS "n_D", count(*) FILTER (action='L') AS "n_L",
  count(*) FILTER (action='R') AS "n_R", count(*) FILTER (action='S') AS "n_S", count(*) AS total FROM steps""")
def ag1_action_counts(spark, d):
    return aggregates.action_counts(steps(spark, d))


@query(f"WITH {EPISODES} SELECT seed, terminal, count(*) AS n FROM episodes GROUP BY ALL")
def ag2_terminal_histogram(spark, d):
    return aggregates.terminal_histogram(episodes(spark, d), "seed")


@query(f"""WITH {EPISODES}, r AS (SELECT seed, count(*) AS games, count(*) FILTER (terminal='cleared') AS wins FROM episodes GROUP BY 1),
  w AS (SELECT *, wins / games AS p, 1.959963984540054 AS z FROM r)
  SELECT seed, games, wins, round(p, 6) AS pass_rate, round(greatest(0, ((p + z*z/(2*games)) - z*sqrt(p*(1-p)/games + z*z/(4*games*games))) / (1 + z*z/games)), 6)::DOUBLE AS low,
  round(least(1, ((p + z*z/(2*games)) + z*sqrt(p*(1-p)/games + z*z/(4*games*games))) / (1 + z*z/games)), 6)::DOUBLE AS high FROM w""")
def ag5_seed_pass_rates_wilson(spark, d):
    rates = aggregates.pass_rates(episodes(spark, d), "seed")
    low, high = statistics.wilson(F.col("wins"), F.col("games"))
    return rates.select("seed", "games", "wins", F.round("pass_rate", 6).alias("pass_rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"""WITH {REWARDS} SELECT group_id, count(*) AS members, count(*) < 2 OR max(reward)-min(reward) > 1e-4 AS range_informative,
  min(reward) <> max(reward) AS unequal, count(DISTINCT reward) > 1 AS many_values FROM rewards GROUP BY 1""")
def flt2_flt3_flt4_group_spread(spark, d):
    return aggregates.group_spread(rewards(spark, d))


@query(f"""WITH {REWARDS}, g AS (SELECT group_id FROM rewards GROUP BY 1 HAVING min(reward) <> max(reward))
  SELECT episode_id, group_id, round(reward, 6) AS reward FROM rewards SEMI JOIN g USING (group_id)""")
def flt3_informative_groups(spark, d):
    return aggregates.informative(rewards(spark, d)).select("episode_id", "group_id", *r6("reward"))


@query(f"""WITH {REWARDS}, g AS (SELECT count(*) AS groups, count(*) FILTER (f) AS flat FROM (SELECT min(reward)=max(reward) AS f FROM rewards GROUP BY group_id))
  SELECT count(*) AS episodes, round(count(*) FILTER (reward >= 1) / count(*), 6) AS win_rate, round(avg(reward), 6) AS mean_reward, any_value(round(flat / groups, 6)) AS zero_variance_groups,
  median(n_steps) FILTER (terminal = 'cleared')::DOUBLE AS success_steps_median FROM rewards, g""")
def ag7_rollout_metrics(spark, d):
    # each decision carries its episode's reward: an episode counts once
    samples = rewards(spark, d).withColumn("won", F.col("terminal") == "cleared").withColumn("decision", F.explode(F.array(F.lit(0), F.lit(1))))
    return aggregates.rollout_metrics(samples).withColumns({c: F.round(c, 6) for c in ("win_rate", "mean_reward", "zero_variance_groups")})


@query(f"""WITH {REWARDS}, g AS (SELECT seed, group_id, count(*) AS n, avg(reward) AS m, var_samp(reward) AS v FROM rewards GROUP BY 1, 2)
  SELECT seed, sum(n)::BIGINT AS episodes, count(*) AS groups, round(avg(m), 6) AS mean_reward, round(avg(v), 6) AS mean_variance FROM g GROUP BY 1""")
def ag9_probe_summary(spark, d):
    return aggregates.probe_summary(rewards(spark, d), "seed").select("seed", "episodes", "groups", *r6("mean_reward", "mean_variance"))


@query("""WITH r AS (SELECT unnest(list_distinct(['all', lang, lang || '@' || source])) AS key, quality = 1 AS hit FROM labels JOIN documents USING (doc_id))
  SELECT key, count(*) AS n, count(*) FILTER (hit) AS hits FROM r GROUP BY 1""")
def ag11_jn1_label_rollup(spark, d):
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return aggregates.multi_key_rollup(both, [F.lit("all"), F.col("lang"), F.concat("lang", F.lit("@"), "source")], F.col("quality") == 1)


@query(f"""WITH {EPISODES}, a AS (SELECT policy, count(*) AS planned, count(*) FILTER (NOT fault) AS tried, count(*) FILTER (terminal='cleared' AND NOT fault) AS wins FROM episodes GROUP BY 1)
  SELECT *, round(wins / tried, 6) AS win_rate, round(wins / planned, 6) AS planned_win_rate FROM a""")
def ag13_ag14_two_denominators(spark, d):
    return aggregates.two_denominators(episodes(spark, d), "policy").withColumns({c: F.round(c, 6) for c in ("win_rate", "planned_win_rate")})


@query(f"""WITH {EPISODES}, b AS (SELECT seed % 4 AS tier, group_id // 64 AS update, count(*) AS games, count(*) FILTER (terminal='cleared') AS wins, list_distinct(list(seed)) AS maps FROM episodes GROUP BY 1, 2)
  SELECT tier, update, games, wins, sum(games) OVER w::BIGINT AS window_games, sum(wins) OVER w::BIGINT AS window_wins, len(list_distinct(flatten(list(maps) OVER w)))::BIGINT AS window_maps
  FROM b WINDOW w AS (PARTITION BY tier ORDER BY update ROWS 4 PRECEDING)""")
def ag15_window_totals(spark, d):
    b = batches(spark, d).withColumnRenamed("run", "tier")
    return aggregates.window_totals(b).drop("maps")


def batches(spark, d):
    e = episodes(spark, d)
    return e.groupBy((F.col("seed") % 4).alias("run"), F.expr("group_id div 64").alias("update")).agg(F.count(F.lit(1)).alias("games"), F.count_if(F.col("terminal") == "cleared").alias("wins"), F.collect_set("seed").alias("maps"))


@query("""WITH a AS (SELECT p_brand, p_size, p_type, count(*) AS frames FROM part GROUP BY ALL), r AS (SELECT p_brand, p_size, count(*) AS positions FROM a GROUP BY ALL),
  l AS (SELECT p_brand, count(*) AS rows FROM r GROUP BY ALL), t AS (SELECT count(*) AS layouts FROM l)
  SELECT p_brand, p_size, p_type, frames, round(1.0 / (layouts * rows * positions * frames), 9)::DOUBLE AS weight FROM a JOIN r USING (p_brand, p_size) JOIN l USING (p_brand), t""")
def ag16_importance_weights(spark, d):
    return aggregates.importance_weights(table(spark, d, "part"), "p_brand", "p_size", "p_type").select("p_brand", "p_size", "p_type", "frames", F.round("weight", 9).alias("weight"))


@query(f"""WITH {REWARDS}, k AS (SELECT reward FROM rewards WHERE NOT fault)
  SELECT count(*) AS n, round(avg(reward), 6) AS mean, round(var_pop(reward), 6) AS variance, round(min(reward), 6) AS least, round(max(reward), 6) AS most FROM k""")
def ag17_masked_moments(spark, d):
    return aggregates.masked_moments(rewards(spark, d), "reward", ~F.col("fault")).select("n", *r6("mean", "variance", "least", "most"))


@query(f"""WITH {STEPS}, m AS (SELECT episode_id, lag(action) OVER w AS a1, action, position, lag(position) OVER w AS p1, lag(position, 2) OVER w AS p2 FROM steps WINDOW w AS (PARTITION BY episode_id ORDER BY step))
  SELECT episode_id, count(*) FILTER (translate(a1, 'UDLR', 'DURL') = action) AS reversals, count(*) FILTER (p2 = position AND p1 <> position) AS abas, count(*) FILTER (p1 <> position) AS moveds FROM m GROUP BY 1""")
def ag22_seq12_behaviour(spark, d):
    return ordered.behaviour(steps(spark, d))


@query("SELECT user_id, event_type, arg_max(value, struct_pack(ts := ts, event_id := event_id)) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def ag23_latest_metrics(spark, d):
    return aggregates.latest_metrics(table(spark, d, "events").where("value IS NOT NULL"), "user_id", "event_type")


@query(f"""WITH {EPISODES}, g AS (SELECT group_id, count(*) AS attempts, bool_or(fault) AS masked, count(*) FILTER (fault) AS n_faults FROM episodes GROUP BY 1)
  SELECT group_id, attempts, masked, CASE WHEN masked THEN 0 ELSE attempts END AS eligible, n_faults FROM g""")
def ag25_batch_plan(spark, d):
    return aggregates.batch_plan(episodes(spark, d)).drop("faults")


@query(f"WITH {REWARDS} SELECT seed, round(sum(reward * n_steps) / sum(n_steps), 6) AS mean, sum(n_steps)::BIGINT AS weight FROM rewards GROUP BY 1")
def ag31_weighted_mean(spark, d):
    return aggregates.weighted_mean(rewards(spark, d), "reward", "n_steps", "seed").withColumn("mean", F.round("mean", 6))


@query(f"WITH {EPISODES}, n AS (SELECT group_id, count(*) AS have FROM episodes GROUP BY 1) SELECT group_id, have, unnest(range(1, 9 - have % 8)) AS slot FROM n WHERE have % 8 > 0")
def nm26_padding(spark, d):
    return aggregates.padded(episodes(spark, d), "group_id", 8)


@query(f"""WITH {EPISODES}, {STEPS} SELECT e.episode_id, coalesce(s.step, -1) AS decision, s.action, s.step IS NOT NULL AS trains FROM episodes e LEFT JOIN steps s USING (episode_id)""")
def prj4_placeholders(spark, d):
    return reports.decisions_or_placeholder(episodes(spark, d), steps(spark, d).select("episode_id", "step", "action"), "episode_id").select("episode_id", "decision", "action", "trains")


# order


@query(f"WITH {STEPS} SELECT episode_id, step, sum(delta) OVER (PARTITION BY episode_id ORDER BY step)::BIGINT AS balance FROM steps")
def seq2_running_balance(spark, d):
    return ordered.running_balance(steps(spark, d)).select("episode_id", "step", "balance")


@query("""WITH s AS (SELECT l_orderkey AS episode_id, l_linenumber::BIGINT AS step, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS tie FROM lineitem),
  g AS (SELECT *, lag(step) OVER (PARTITION BY episode_id ORDER BY step, tie) AS before FROM s) SELECT episode_id, step, before FROM g WHERE step <> before + 1""")
def seq1_gaps(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("episode_id"), F.col("l_linenumber").cast("long").alias("step"))
    return ordered.gaps(rows)


@query(f"""WITH {STEPS}, i AS (SELECT *, count(*) FILTER (delta > 0) OVER (PARTITION BY episode_id ORDER BY step) AS island FROM steps),
  r AS (SELECT episode_id, count(*) AS n FROM i WHERE delta <= 0 GROUP BY episode_id, island)
  SELECT episode_id, coalesce(max(n), 0) AS longest FROM (SELECT DISTINCT episode_id FROM steps) LEFT JOIN r USING (episode_id) GROUP BY 1""")
def seq4_dry_streak(spark, d):
    return ordered.longest_dry_streak(steps(spark, d))


@query(f"""WITH {STEPS}, m AS (SELECT episode_id, action, position, lag(action) OVER w AS a1, lag(position, 2) OVER w AS p2 FROM steps WINDOW w AS (PARTITION BY episode_id ORDER BY step))
  SELECT episode_id, count(*) FILTER (p2 = position AND translate(a1, 'UDLR', 'DURL') = action) AS returns FROM m GROUP BY 1""")
def seq6_oscillations(spark, d):
    return ordered.oscillations(steps(spark, d))


@query(f"WITH {STEPS} SELECT episode_id, step, string_agg(action, '') OVER (PARTITION BY episode_id ORDER BY step ROWS 7 PRECEDING) AS recent FROM steps")
def seq8_recent_actions(spark, d):
    return ordered.recent(steps(spark, d))


@query("""WITH n AS (SELECT user_id, event_id, row_number() OVER w - 1 AS distance, first_value(event_type) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)) SELECT user_id, event_id, distance FROM n WHERE distance IN (4, 8, 16) AND last IN ('error', 'click', 'view')""")
def seq9_ring(spark, d):
    """Rings of users whose last event is a death (here: one of three types)."""
    died = F.col("event_type").isin("error", "click", "view")
    return ordered.before_end(table(spark, d, "events"), "user_id", TIE, died=died).select("user_id", "event_id", "distance")


@query("""WITH n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
  x AS (SELECT user_id, pos, coalesce(lag(pos) OVER (PARTITION BY user_id ORDER BY pos), 0) AS last FROM n WHERE event_type = 'error'),
  b AS (SELECT *, unnest(range(4, 33)) AS back FROM x) SELECT user_id, pos AS place, back, pos + 1 - back AS start FROM b WHERE pos + 1 - back > last""")
def seq11_lookbacks(spark, d):
    return ordered.lookbacks(table(spark, d, "events"), "user_id", TIE, F.col("event_type") == "error").withColumnRenamed("at", "place")


@query("""WITH n AS (SELECT event_id, user_id, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT user_id, event_id FROM n WHERE list_contains(list_transform(range(0, 5), lambda i: ((2 * i + 1) * n) // 10), pos)""")
def seq13_evenly_spaced(spark, d):
    return ordered.evenly_spaced(table(spark, d, "events"), "user_id", TIE, 5).select("user_id", "event_id")


@query(f"""WITH {STEPS}, n AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY step DESC) AS k FROM steps) SELECT episode_id, step FROM n WHERE step % 3 = 0 OR k <= 2""")
def seq16_stride_and_tail(spark, d):
    return ordered.stride_and_tail(steps(spark, d), 3, 2).select("episode_id", "step")


@query("""WITH n AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
  t AS (SELECT p_brand, p_partkey, ((pos - 35) % n + n) % n AS turn FROM n) SELECT * FROM t WHERE turn < 5""")
def seq17_rotation(spark, d):
    return ordered.rotated(table(spark, d, "part"), "p_brand", "p_partkey", 7, 5).select("p_brand", "p_partkey", "turn")


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type='error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS marker FROM events""")
def jn15_as_of(spark, d):
    return ordered.as_of(table(spark, d, "events"), "user_id", TIE, F.when(F.col("event_type") == "error", F.col("event_id")), "marker").select("event_id", "user_id", "marker")


@query("""WITH m AS (SELECT event_id, user_id, ts, event_type, last_value(CASE WHEN event_type='error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS marker FROM events),
  n AS (SELECT *, row_number() OVER (PARTITION BY user_id, marker ORDER BY ts, event_id) AS k FROM m WHERE event_type <> 'error' AND marker IS NOT NULL) SELECT event_id, user_id, marker FROM n WHERE k = 1""")
def seq7_marker_consumers(spark, d):
    return ordered.marker_consumers(table(spark, d, "events"), "user_id", TIE, F.when(F.col("event_type") == "error", F.col("event_id"))).select("event_id", "user_id", "marker")


# statistics


@query(f"WITH {REWARDS} SELECT episode_id, group_id, CASE WHEN min(reward) OVER w = max(reward) OVER w THEN 0.0 ELSE round(reward - avg(reward) OVER w, 6) END::DOUBLE AS advantage FROM rewards WINDOW w AS (PARTITION BY group_id)")
def nm8_group_centering(spark, d):
    return statistics.centered(rewards(spark, d)).select("episode_id", "group_id", *r6("advantage"))


@query(f"""WITH {REWARDS}, s AS (SELECT episode_id, reward, avg(reward) OVER w AS m, stddev_pop(reward) OVER w AS sd, bool_or(fault) OVER w AS masked FROM rewards WINDOW w AS (PARTITION BY group_id))
  SELECT episode_id, CASE WHEN masked THEN NULL WHEN sd < 1e-12 THEN 0.0 ELSE round((reward - m) / (sd + 1e-8), 5) END::DOUBLE AS advantage FROM s""")
def nm27_standardised_advantages(spark, d):
    return statistics.standardised(rewards(spark, d), F.col("fault")).select("episode_id", F.round("advantage", 5).alias("advantage"))


@query(f"WITH {REWARDS}, v AS (SELECT group_id, var_samp(reward) AS v FROM rewards GROUP BY 1) SELECT group_id, round(v / pow(sqrt(v) + 1e-5, 2), 6) AS advantage_variance FROM v")
def nm28_advantage_variance(spark, d):
    return statistics.advantage_variance(rewards(spark, d)).select("group_id", *r6("advantage_variance"))


@query(f"WITH {REWARDS} SELECT episode_id, round(reward, 6) AS reward, round(CASE WHEN terminal='cleared' THEN 1.0::DOUBLE + 0.1::DOUBLE * (1 - (seed + n_steps) / 1000) ELSE 0.0::DOUBLE END, 6) AS budget FROM rewards")
def nm9_nm29_rewards(spark, d):
    budget = statistics.budget_reward(F.col("terminal") == "cleared", F.col("seed"), F.col("n_steps"))
    return rewards(spark, d).select("episode_id", *r6("reward"), F.round(budget, 6).alias("budget"))


@query("""WITH c AS (SELECT count(*) FILTER (quality=1 AND toxic<>1) AS only_a, count(*) FILTER (toxic=1 AND quality<>1) AS only_b FROM labels),
  k AS (SELECT *, only_a + only_b AS n, least(only_a, only_b) AS k FROM c)
  SELECT only_a, only_b, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0::DOUBLE))))) END, 9)::DOUBLE AS p_value FROM k""")
def nm7_mcnemar(spark, d):
    return statistics.mcnemar(table(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 1).withColumn("p_value", F.round("p_value", 9))


@query("SELECT user_id % 7 AS bin, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def nm13_ag29_quantiles(spark, d):
    rows = table(spark, d, "events").select((F.col("user_id") % 7).alias("bin"), "value")
    found = orderstats.linear_quantiles(rows, ["bin"], "value", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return found.select("bin", *r6("p05", "p50", "p95"))


@query("""WITH v AS (SELECT user_id % 7 AS bin, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT bin, v[(round_even((len(v) - 1) * 0.5, 0) + 1)::INT] AS p50, v[(round_even((len(v) - 1) * 0.95, 0) + 1)::INT] AS p95 FROM v""")
def nm14_nearest_rank(spark, d):
    rows = table(spark, d, "events").select((F.col("user_id") % 7).alias("bin"), "value")
    return orderstats.nearest_ranks(rows, ["bin"], "value", {"p50": 0.5, "p95": 0.95})


CLIP = """c AS (SELECT user_id, event_id, (value - avg(value) OVER w) * (event_id % 97 / -10.0::DOUBLE - avg(event_id % 97 / -10.0::DOUBLE) OVER w) AS cov, count(*) OVER w AS n
    FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id)),
  e AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS eligible, row_number() OVER (PARTITION BY user_id ORDER BY sha256('7|' || event_id), event_id) AS place FROM c WHERE cov > 1 AND cov < 50)"""


@query(f"""WITH {CLIP} SELECT user_id, event_id, round(cov, 4) AS cov FROM e WHERE place <= least(greatest((0.02::DOUBLE * n)::DECIMAL(18, 6)::BIGINT - CASE WHEN (0.02::DOUBLE * n)::DECIMAL(18, 6)::BIGINT > 0.02::DOUBLE * n THEN 1 ELSE 0 END, 1), eligible)""")
def nm11_clip_selection(spark, d):
    rows = table(spark, d, "events").where("value IS NOT NULL").select("user_id", "event_id", "value", (F.col("event_id") % 97 / -10.0).alias("logp"))
    return statistics.clip_selection(rows, "user_id", "event_id", "value", "logp", ratio=0.02, low=1.0, high=50.0, seed="7").select("user_id", "event_id", F.round("cov", 4).alias("cov"))


@query(f"""WITH {CLIP}, s AS (SELECT user_id, count(*) AS decisions, count(*) FILTER (cov > 1 AND cov < 50) AS eligible FROM c GROUP BY 1)
  SELECT *, least(greatest(floor(0.02::DOUBLE * decisions)::BIGINT, 1), eligible) AS selected FROM s""")
def nm11_val20_clip_summary(spark, d):
    rows = table(spark, d, "events").where("value IS NOT NULL").select("user_id", "event_id", "value", (F.col("event_id") % 97 / -10.0).alias("logp"))
    return statistics.clip_summary(rows, "user_id", "value", "logp", ratio=0.02, low=1.0, high=50.0)


@query("""WITH l AS (SELECT p_partkey, [p_size / 10, p_retailprice / 1000, (p_partkey % 7) / 3] AS x FROM part),
  s AS (SELECT p_partkey, list_transform(x, lambda v: v - (list_max(x) + ln(list_sum(list_transform(x, lambda u: exp(u - list_max(x))))))) AS p FROM l)
  SELECT p_partkey, round(p[1], 6) AS first, round(-list_sum(list_transform(p, lambda v: exp(v) * v)), 6) AS entropy, round(list_sum(list_transform(p, lambda v: exp(v) * (v + ln(3::DOUBLE)))), 6) AS divergence FROM s""")
def nm15_nm16_softmax_entropy_kl(spark, d):
    logits = F.array(F.col("p_size") / 10, F.col("p_retailprice") / 1000, (F.col("p_partkey") % 7) / 3)
    p = table(spark, d, "part").select("p_partkey", statistics.log_softmax(logits).alias("p"))
    flat = F.array(*[-F.log(F.lit(3.0))] * 3)
    return p.select("p_partkey", F.round(F.col("p")[0], 6).alias("first"), F.round(statistics.entropy(F.col("p")), 6).alias("entropy"), F.round(statistics.divergence(F.col("p"), flat), 6).alias("divergence"))


@query("SELECT l_orderkey, round(least(r * a, greatest(least(r, 1.2), 0.8) * a), 6)::DOUBLE AS term FROM (SELECT l_orderkey, l_quantity / 25 AS r, l_discount - 0.05::DOUBLE AS a FROM lineitem)")
def nm17_clipped_term(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") / 25).alias("r"), (F.col("l_discount") - 0.05).alias("a"))
    return rows.select("l_orderkey", F.round(statistics.clipped_term(F.col("r"), F.col("a")), 6).alias("term"))


@query()
def nm2_bootstrap_rate(spark, d):
    return statistics.bootstrap_rate(episodes(spark, d).withColumn("won", F.col("terminal") == "cleared"), "seed")


# selection and sets


@query("""WITH t AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) SELECT * FROM t WHERE place <= 3""")
def sel15_top_k(spark, d):
    return selection.first_of(table(spark, d, "part"), ["p_brand"], F.col("p_retailprice").desc(), F.col("p_partkey"), k=3).select("p_brand", "p_partkey", "p_retailprice", "place")


@query("""WITH n AS (SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
  SELECT o_orderpriority, CASE WHEN pos = n // 2 THEN 'typical' ELSE '' END || CASE WHEN pos = n - 1 THEN 'best' ELSE '' END || CASE WHEN pos = 0 THEN 'worst' ELSE '' END AS role, o_orderkey, o_totalprice FROM n WHERE pos = n // 2 OR pos = 0 OR pos = n - 1""")
def sel4_typical_best_worst(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return selection.typical_best_worst(rows, "o_orderpriority", "o_totalprice", "o_orderkey")


@query("""WITH a AS (SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS round FROM events),
  b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round, user_id) AS place FROM a) SELECT * FROM b WHERE place <= 64""")
def sel10_round_robin(spark, d):
    return selection.round_robin(table(spark, d, "events"), "event_type", "user_id", [F.col("ts").desc(), F.col("event_id").desc()], 64).select("event_type", "user_id", "event_id", "round", "place")


@query("""WITH a AS (SELECT p_brand, p_type, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice, p_partkey) = 1 AS f FROM part),
  b AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY f DESC, p_retailprice, p_partkey) AS place FROM a) SELECT * FROM b WHERE place <= 4""")
def sel21_diverse_top(spark, d):
    return selection.diverse_top(table(spark, d, "part"), "p_brand", ["p_type"], [F.col("p_retailprice"), F.col("p_partkey")], 4).select("p_brand", "p_partkey", "place")


@query("""WITH h AS (SELECT o_orderpriority, o_orderkey, sha256('s1|' || o_orderpriority || '|' || o_orderkey) AS digest FROM orders),
  n AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY digest, o_orderkey) AS place FROM h) SELECT * FROM n WHERE place <= 16""")
def sel22_hash_subset(spark, d):
    return selection.hash_subset(table(spark, d, "orders"), "o_orderpriority", "o_orderkey", "s1", 16).select("o_orderpriority", "o_orderkey", "digest", "place")


@query(f"WITH {EPISODES}, n AS (SELECT episode_id, group_id, fault, (row_number() OVER (PARTITION BY group_id ORDER BY episode_id) - 1) % 4 AS rank FROM episodes) SELECT episode_id, group_id, rank FROM n WHERE NOT fault")
def sel23_rank_shards(spark, d):
    return selection.shards(episodes(spark, d), "group_id", ["episode_id"], 4, ~F.col("fault")).select("episode_id", "group_id", "rank")


PARTS = "c AS (SELECT p_partkey, sha256(p_brand || p_type) AS layout, CASE WHEN p_partkey % 10 < 7 THEN 'train' WHEN p_partkey % 10 < 8 THEN 'validation' ELSE 'test' END AS split FROM part)"


def catalog(spark, d):
    at = F.col("p_partkey") % 10
    return table(spark, d, "part").select("p_partkey", F.sha2(F.concat("p_brand", "p_type"), 256).alias("layout"), F.when(at < 7, "train").when(at < 8, "validation").otherwise("test").alias("split"))


@query(f"WITH {PARTS} SELECT layout, count(DISTINCT split) AS splits, count(*) AS n FROM c GROUP BY 1 HAVING count(DISTINCT split) > 1")
def set2_split_leakage(spark, d):
    return selection.leaking(catalog(spark, d), "layout", "split")


@query(f"WITH {PARTS} SELECT p_partkey, layout FROM c WHERE split = 'train' AND layout NOT IN (SELECT layout FROM c WHERE split = 'test')")
def set3_reserved(spark, d):
    c = catalog(spark, d)
    return selection.reserved(c.where("split = 'train'"), "layout", c.where("split = 'test'")).select("p_partkey", "layout")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def set7_repeated_ids(spark, d):
    return selection.repeated_ids(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("""SELECT o_orderkey AS id, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, -o_totalprice FROM orders WHERE o_orderkey % 3 = 0""")
def set4_latest_union(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    return selection.latest_union(o, o.where("id % 3 = 0").withColumn("v", -F.col("v")), "id")


@query("""SELECT coalesce(a.label, b.label) AS label, CASE WHEN a.label IS NULL THEN 'right' ELSE 'left' END AS side
  FROM (SELECT DISTINCT o_custkey AS label FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0) a FULL JOIN (SELECT DISTINCT o_custkey AS label FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 = 1) b USING (label) WHERE a.label IS NULL OR b.label IS NULL""")
def set5_jn2_missing_sides(spark, d):
    o = table(spark, d, "orders")
    side = lambda status, n: o.where((F.col("o_orderstatus") == status) & (F.col("o_orderkey") % 3 == n)).select(F.col("o_custkey").alias("label"))
    return selection.missing_sides(side("F", 0), side("O", 1), "label")


@query(f"WITH {EPISODES}, n AS (SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY episode_id) - 1 AS i FROM episodes WHERE NOT fault) SELECT group_id, count(*) AS have FROM n GROUP BY 1 HAVING list_sort(list(i)) <> range(0, 12)")
def val14_set6_coverage(spark, d):
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("group_id").orderBy("episode_id")) - 1
    return selection.uncovered(episodes(spark, d).where("NOT fault").withColumn("i", i), "group_id", "i", 12)


# validation, functions, joins, graphs, state


@query(f"""WITH {EPISODES}, v AS (SELECT episode_id, unnest([CASE WHEN deaths >= 3 AND terminal = 'cleared' THEN 'lives' END, CASE WHEN n_steps > 500 THEN 'horizon' END, CASE WHEN fault THEN 'fault' END]) AS rule FROM episodes) SELECT * FROM v WHERE rule IS NOT NULL""")
def val1_rule_table(spark, d):
    rules = [audit.Rule("lives", (F.col("deaths") >= 3) & (F.col("terminal") == "cleared")), audit.Rule("horizon", F.col("n_steps") > 500), audit.Rule("fault", F.col("fault"))]
    return audit.violations(episodes(spark, d), rules, "episode_id")


@query(f"""WITH {STEPS}, s AS (SELECT episode_id, count(*) AS seen, sum(delta) AS balance FROM steps GROUP BY 1),
  h AS (SELECT *, seen + (episode_id % 5 = 0)::INT AS steps, balance + (episode_id % 7 = 0)::INT AS score FROM s),
  v AS (SELECT episode_id, unnest([CASE WHEN seen <> steps THEN 'steps' END, CASE WHEN balance <> score THEN 'balance' END]) AS rule FROM h) SELECT * FROM v WHERE rule IS NOT NULL""")
def val2_ledger(spark, d):
    sums = audit.ledger_sums(steps(spark, d))
    off = lambda n: (F.col("episode_id") % n == 0).cast("long")
    headers = sums.withColumns({"steps": F.col("seen") + off(5), "score": F.col("balance") + off(7)})
    return audit.violations(headers, audit.ledger_rules(), "episode_id")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest, ('0x' || substr(sha256(coalesce(text, '')), 1, 8))::BIGINT AS seed FROM documents")
def fn1_fn2_hash_seeds(spark, d):
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.sha2(text, 256).alias("digest"), scalar.seed32(text).alias("seed"))


@query("""SELECT event_id, (r // 4) || '|' || (c // 4) || '|' || CASE WHEN d IS NULL OR d >= 6 THEN '6+' WHEN d <= 2 THEN '0-2' ELSE '3-5' END || '|' || CASE WHEN p <= 10 THEN '0-10' WHEN p <= 40 THEN '11-40' ELSE '41+' END AS bucket
  FROM (SELECT event_id, event_id % 25 AS r, user_id % 21 AS c, CASE WHEN user_id % 11 = 0 THEN NULL ELSE user_id % 9 END AS d, event_id % 61 AS p FROM events)""")
def fn6_bucket_keys(spark, d):
    u, e = F.col("user_id"), F.col("event_id")
    return table(spark, d, "events").select("event_id", scalar.bucket_key(e % 25, u % 21, F.when(u % 11 != 0, u % 9), e % 61).alias("bucket"))


@query(f"""WITH {EPISODES} SELECT group_id, CASE WHEN count(*) FILTER (terminal = 'cleared') = 0 THEN 'blocked' WHEN count(*) FILTER (terminal = 'cleared') = count(*) THEN 'very_easy' ELSE 'mixed' END AS tier FROM episodes GROUP BY 1""")
def fn7_tier_labels(spark, d):
    rates = aggregates.pass_rates(episodes(spark, d), "group_id")
    return rates.select("group_id", scalar.tier_label(F.col("wins"), F.col("games")).alias("tier"))


@query(r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}_-]', '_', 'g') AS name FROM pages")
def fn8_safe_names(spark, d):
    return table(spark, d, "pages").select("page_id", scalar.safe_name(F.col("url")).alias("name"))


@query("""SELECT l_orderkey, l_partkey, greatest(0, lives + (b < 25000 AND a >= 25000)::INT + (b < 50000 AND a >= 50000)::INT + (b < 100000 AND a >= 100000)::INT + (b < 150000 AND a >= 150000)::INT - died::INT)::BIGINT AS lives_after
  FROM (SELECT l_orderkey, l_partkey, l_linenumber % 4 AS lives, l_extendedprice - 20000 AS b, l_extendedprice AS a, l_returnflag = 'R' AS died FROM lineitem)""")
def fn25_lives(spark, d):
    x = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", scalar.lives_after(F.col("l_linenumber") % 4, x - 20000, x, F.col("l_returnflag") == "R").cast("long").alias("lives_after"))


@query("SELECT event_id, round(CASE WHEN s < 100 THEN 0.001::DOUBLE * (s + 1) / 100 ELSE 0.001::DOUBLE * 0.5::DOUBLE * (1 + cos(pi() * (s - 100) / 900)) END, 9) AS rate FROM (SELECT event_id, event_id % 1000 AS s FROM events)")
def fn26_schedule(spark, d):
    return table(spark, d, "events").select("event_id", F.round(scalar.warmup_cosine(F.col("event_id") % 1000, 100, 1000, 0.001), 9).alias("rate"))


ANSWERS = """a AS (SELECT conv_id, turn, CASE (conv_id * 7 + turn) % 9 WHEN 0 THEN ' UP ' WHEN 1 THEN 'I think {"reason": "down?", "action": "Left"} and right' WHEN 2 THEN 'Let me see.' || chr(10) || ' Final action = down, or up'
  WHEN 3 THEN 'reason: left' || chr(10) || 'final answer: right.' WHEN 4 THEN 'bad {"action": "jump"} then stay or up' WHEN 5 THEN 'update the leftmost' WHEN 6 THEN 'action: left' WHEN 7 THEN '{broken "action": "up"} right' ELSE text END AS answer FROM conversations)"""
CHOICE = "(up|down|left|right|stay)"


@query(rf"""WITH {ANSWERS}, l AS (SELECT conv_id, turn, answer, lower(trim(answer, ' ' || chr(9) || chr(10) || chr(13))) AS t FROM a),
  p AS (SELECT *, CASE WHEN t IN ('up', 'down', 'left', 'stay') THEN t END AS exact,
    CASE WHEN lower(regexp_extract(answer, '\{{"[^{{}}]*"action": "([A-Za-z]*)"\}}', 1)) IN ('up', 'down', 'left', 'stay') THEN lower(regexp_extract(answer, '\{{"[^{{}}]*"action": "([A-Za-z]*)"\}}', 1)) END AS object,
    regexp_extract(t, '(?:^|\n)\s*(?:final\s+)?action\s*[:=]\s*{CHOICE}\b', 1) AS line, regexp_extract(t, '(?:^|\n)\s*final\s+answer\s*[:=]\s*{CHOICE}\b', 1) AS final,
    list_filter(regexp_extract_all(t, '\b{CHOICE}\b', 1), lambda x: x <> 'right')[1] AS word FROM l)
  SELECT conv_id, turn, coalesce(exact, object, CASE WHEN line NOT IN ('', 'right') THEN line END, CASE WHEN final NOT IN ('', 'right') THEN final END, word, 'stay') AS action FROM p""")
def fn12_parsed_actions(spark, d):
    said = {0: " UP ", 1: 'I think {"reason": "down?", "action": "Left"} and right', 2: "Let me see.\n Final action = down, or up", 3: "reason: left\nfinal answer: right.", 4: 'bad {"action": "jump"} then stay or up', 5: "update the leftmost", 6: "action: left", 7: '{broken "action": "up"} right'}
    at = (F.col("conv_id") * 7 + F.col("turn")) % 9
    answer = F.coalesce(*(F.when(at == k, F.lit(v)) for k, v in said.items()), F.when(at == 8, F.col("text")))
    return table(spark, d, "conversations").select("conv_id", "turn", scalar.parsed_action(answer, allowed=("up", "down", "left", "stay")).alias("action"))


@query("SELECT c.c_custkey, s.s AS seed FROM customer c, range(0, 4) s(s)")
def jn10_seed_plan(spark, d):
    return reports.seed_plan(table(spark, d, "customer").select("c_custkey"), range(4))


@query("SELECT o_orderkey, coalesce(w.n, 1) AS weight FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) w ON o_orderkey = l_orderkey")
def jn14_default_weight(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "orders").select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(1)).alias("weight"))


@query("""WITH b AS (SELECT l_orderkey, l_partkey, CASE WHEN l_quantity BETWEEN 1 AND 8 THEN 'short' WHEN l_quantity BETWEEN 9 AND 16 THEN 'middle' WHEN l_quantity BETWEEN 17 AND 32 THEN 'long' END AS bin FROM lineitem) SELECT bin, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY 1""")
def jn12_range_bins(spark, d):
    rows = reports.in_bins(table(spark, d, "lineitem").select("l_quantity"), "l_quantity", [(1, 8, "short"), (9, 16, "middle"), (17, 32, "long")])
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, nullif(o_orderpriority, '1-URGENT') AS p FROM orders)
  SELECT 'orders' AS name, count(*) AS rows, count(DISTINCT o_orderkey) AS keys, sha256(sum(('0x' || substr(sha256('v' || o_orderkey || chr(31) || coalesce('v' || o_orderstatus, 'n') || chr(31) || coalesce('v' || p, 'n')), 1, 15))::BIGINT)::VARCHAR) AS digest FROM o""")
def snk6_manifest(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")).alias("p"))
    return sinks.manifest(o, "orders", "o_orderkey")
