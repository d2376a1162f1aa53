"""Queries of the rule tables: recorded rows with faults put in by the remainders of their keys, and the rules that must find them."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, reports
from ..operators import contracts as ct
from ..sources import readers, sinks
from ..sources.bindings import EPISODES, STEPS, TASK_ROWS, episodes, steps, table
from .core import query
from .files import put

L = F.lit


def broken_sql(table_sql: str, key: str, rules: dict[str, str], source: str) -> str:
    """(key, rule) of every rule whose condition says that a row of `source` breaks it."""
    cases = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules.items())
    return f"WITH {table_sql}, _v AS (SELECT {key}, unnest([{cases}]) AS rule FROM {source}) SELECT * FROM _v WHERE rule IS NOT NULL"


def hit(column: str, n: int):
    return F.col(column) % n == 0


HEADER_FAULTS = {
    "api_version": "k % 97 = 0", "commit": "k % 89 = 0", "revision": "k % 83 = 0", "renderer": "k % 81 = 0", "level": "k % 79 = 0", "max_steps": "k % 73 = 0", "refusal_coefficient": "k % 71 = 0", "violation_return": "k % 67 = 0", "life_mode": "k % 64 = 0",
    "reason": "k % 63 = 0", "steps": "k % 61 = 0", "shaped_total": "k % 59 = 0", "base_total": "k % 58 = 0", "parse_failures": "k % 57 = 0", "death_count": "k % 53 = 0", "ended": "terminal <> 'max_steps' AND k % 47 = 0", "flags": "k % 47 = 0 AND terminal <> 'max_steps' OR k % 43 = 0",
    "final_score": "k % 41 = 0", "pellets": "k % 37 = 0", "won": "k % 31 = 0",
}


def headers(spark, d) -> DataFrame:
    e = episodes(spark, d).withColumn("k", F.col("episode_id"))
    k = F.col("k")
    commit = F.when(hit("k", 89), "xyz").otherwise(F.substring(F.sha2(k.cast("string"), 256), 1, 40))
    reason = F.when(hit("k", 63), "other").when(F.col("terminal") == "cleared", "all_normal_pellets").otherwise(F.col("terminal"))
    remaining = F.when((F.col("terminal") == "cleared") & ~hit("k", 63), 0).otherwise(k % 9 + 1)
    timeout = F.col("terminal") == "max_steps"
    return e.select(
        "episode_id", F.when(hit("k", 97), "v2").otherwise("v3").alias("api_version"), L("slow").alias("backend"), commit.alias("commit"), F.when(hit("k", 83), "other").otherwise(commit).alias("revision"),
        F.concat(F.when(hit("k", 81), "r:").otherwise("renderer:"), commit).alias("renderer"), F.sha2(L("rules"), 256).alias("ruleset"), F.when(hit("k", 79), "short").otherwise(F.sha2(L("level"), 256)).alias("level"),
        F.when(hit("k", 73), 300).otherwise(512).alias("max_steps"), F.when(hit("k", 71), L(float("nan"))).otherwise(0.5).alias("refusal_coefficient"), F.when(hit("k", 67), -0.5).otherwise(-1.0).alias("violation_return"),
        F.when(hit("k", 64), "nine_lives").otherwise("single_death").alias("life_mode"), reason.alias("reason"), F.col("n_steps").alias("steps"), (F.col("n_steps") + hit("k", 61).cast("int")).alias("seen_steps"),
        (k / 16).alias("shaped_total"), (k / 16 + F.when(hit("k", 59), 1e-6).otherwise(0.0)).alias("seen_shaped"), (k % 7).cast("double").alias("base_total"), (k % 7 + hit("k", 58).cast("int")).cast("double").alias("seen_base"),
        L(0).alias("parse_failures"), hit("k", 57).cast("int").alias("seen_failures"), F.col("deaths").alias("death_count"), (F.col("deaths") + hit("k", 53).cast("int")).alias("seen_deaths"),
        (~timeout).alias("terminated"), (timeout & ~hit("k", 43) | ~timeout & hit("k", 43)).alias("truncated"), (~timeout & ~hit("k", 47)).alias("last_terminated"), timeout.alias("last_truncated"), (k % 100).alias("final_score"), (k % 100 + hit("k", 41).cast("int")).alias("last_score"),
        L(100).alias("pellets_initial"), remaining.alias("last_remaining"), (100 - remaining + hit("k", 37).cast("int")).alias("pellets_eaten"), ((reason == "all_normal_pellets") != hit("k", 31)).alias("won"),
    )


@query(broken_sql(EPISODES + ", h AS (SELECT *, episode_id AS k FROM episodes)", "episode_id", HEADER_FAULTS, "h"))
def val1_header_rules(spark, d):
    return audit.violations(headers(spark, d), ct.header_rules((287, 512)), "episode_id")


@query(f"""WITH {EPISODES}, x AS (SELECT episode_id AS k FROM episodes), bad AS (SELECT DISTINCT k FROM x WHERE {" OR ".join(f"({c})" for c in HEADER_FAULTS.values() if "terminal" not in c)} OR k % 43 = 0 OR k IN (SELECT episode_id FROM episodes WHERE terminal <> 'max_steps' AND episode_id % 47 = 0)) SELECT episode_id FROM episodes WHERE episode_id NOT IN (SELECT k FROM bad)""")
def val8_quarantined(spark, d):
    """What is left of a folder of episodes when those that break a rule are set apart."""
    return audit.quarantined(headers(spark, d), ct.header_rules((287, 512)), "episode_id").select("episode_id")


STEPPED = f"""{STEPS}, s AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY step) AS place, step = max(step) OVER (PARTITION BY episode_id) AS last, sum(abs(delta)) OVER (PARTITION BY episode_id ORDER BY step)::BIGINT * 4000 AS score FROM steps),
  z AS (SELECT *, coalesce(lag(score) OVER (PARTITION BY episode_id ORDER BY step), 0) AS before, episode_id % 13 = 0 AND step = 2 AS moved, position = 4 AS died FROM s),
  y AS (SELECT *, step % 4 AS lives, greatest(0, step % 4 + (before < 25000 AND score >= 25000)::INT + (before < 50000 AND score >= 50000)::INT + (before < 100000 AND score >= 100000)::INT + (before < 150000 AND score >= 150000)::INT - died::INT) AS after FROM z)"""


@query(broken_sql(STEPPED, "episode_id, step", {"step": "episode_id % 11 = 0", "action": "position = 3 AND episode_id % 5 = 0", "after_end": "NOT last AND episode_id % 7 = 0 AND step = 1", "lives": "episode_id % 17 = 0", "deaths": "episode_id % 19 = 0"}, "y"))
def val1_fn25_step_rules(spark, d):
    from pyspark.sql import Window

    from ..functions.scalar import lives_after

    w = Window.partitionBy("episode_id").orderBy("step")
    e = F.col("episode_id")
    s = steps(spark, d).withColumn("score", F.sum(F.abs("delta")).over(w) * 4000)
    s = s.withColumns({"score_before": F.coalesce(F.lag("score").over(w), L(0)), "place": F.row_number().over(w), "last": F.col("step") == F.max("step").over(Window.partitionBy("episode_id")), "death": F.col("position") == 4, "lives": F.col("step") % 4})
    died = F.coalesce(F.sum(F.col("death").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), L(0))
    s = s.withColumns({
        "real": F.col("step"), "deaths_before": died, "death_count": died + F.col("death").cast("int") + (e % 19 == 0).cast("int"), "lives_after": lives_after(F.col("lives"), F.col("score_before"), F.col("score"), F.col("death")) + (e % 17 == 0).cast("int"),
        "action": F.when((F.col("position") == 3) & (e % 5 == 0), "X").otherwise(F.col("action")), "terminated": (e % 7 == 0) & (F.col("step") == 1), "truncated": L(False), "parse_failed": L(False),
    })
    s = s.withColumn("step", F.col("step") + (e % 11 == 0).cast("int"))
    found = audit.violations(s, ct.step_rules(), "episode_id", "real")
    return found.withColumnRenamed("real", "step")


FRAMES = """f AS (SELECT *, (n - 1) // 2 + 1 AS step, CASE WHEN n % 2 = 0 AND l_suppkey % 41 = 0 THEN 3 ELSE (n - 1) % 2 + 1 END AS idx, n + (l_suppkey % 23 = 0)::INT AS frame, sum(delta) OVER (PARTITION BY l_orderkey ORDER BY n) + (l_suppkey % 29 = 0)::INT AS score FROM (
    SELECT *, l_orderkey AS episode_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS n, [10, 100, 200, 2500, 0, 0][(l_partkey % 6 + 1)::INT] AS delta, l_partkey % 6 <> 4 AS has, l_partkey % 37 = 0 AND l_partkey % 6 <> 4 AS off FROM lineitem)),
  g AS (SELECT *, frame - coalesce(lag(frame) OVER (PARTITION BY episode_id ORDER BY n), 0) <> 1 AS jump, score - coalesce(lag(score) OVER (PARTITION BY episode_id ORDER BY n), 0) <> delta AS gap FROM f)"""
FRAME_FAULTS = {
    "frame_index": "idx = 3", "frame_contiguous": "jump", "score_delta": "gap", "components": "l_partkey % 31 = 0", "event_value": "off", "event_frame": "has AND (l_suppkey % 23 = 0 OR idx = 3)", "event_score": "off",
    "event_normal_pellet": "off AND l_partkey % 6 = 0", "event_power_pellet": "off AND l_partkey % 6 = 1", "event_ghost": "off AND l_partkey % 6 = 2", "event_fruit": "off AND l_partkey % 6 = 3", "event_other": "off AND l_partkey % 6 = 5",
}


def frames(spark, d) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("n")
    rows = table(spark, d, "lineitem").withColumns({"n": F.row_number().over(w), "kind": p % 6})
    kind = F.col("kind")
    delta = F.element_at(F.array(*map(L, (10, 100, 200, 2500, 0, 0))), (kind + 1).cast("int")).cast("long")
    name = F.element_at(F.array(*map(L, ("normal_pellet_eaten", "power_pellet_eaten", "ghost_eaten", "fruit_eaten", "none", "level_cleared"))), (kind + 1).cast("int"))
    rows = rows.withColumns({"delta": delta, "score": F.sum(delta).over(w) + (s % 29 == 0).cast("int"), "idx": F.when((n % 2 == 0) & (s % 41 == 0), 3).otherwise((n - 1) % 2 + 1), "frame": n + (s % 23 == 0).cast("int")})
    event = F.struct(name.alias("type"), (F.col("delta") + F.when(p % 37 == 0, 5).otherwise(0)).alias("delta"), ((n - 1) % 2 + 1).alias("idx"), n.alias("frame"))
    parts = F.struct(*(F.when(kind == i, F.col("delta")).otherwise(0).cast("long").alias(c) for i, c in enumerate(("normal_pellet", "power_pellet", "ghost", "fruit"))), L(0).cast("long").alias("other"), (F.col("delta") + (p % 31 == 0).cast("int")).alias("total"))
    return rows.select(F.col("l_orderkey").alias("episode_id"), F.expr("cast((n - 1) div 2 + 1 as bigint)").alias("step"), "idx", "frame", "score", "delta", parts.alias("components"), F.when(kind != 4, F.array(event)).otherwise(F.array().cast("array<struct<type:string,delta:bigint,idx:int,frame:int>>")).alias("events"))


@query("SELECT DISTINCT * FROM (" + broken_sql(FRAMES, "episode_id, step", FRAME_FAULTS, "g") + ")")
def val2_frame_ledger(spark, d):
    return ct.ledger(frames(spark, d))


@query(f"""WITH {FRAMES}, s AS (SELECT episode_id, step FROM f GROUP BY 1, 2), v AS (SELECT episode_id, step, unnest([CASE WHEN episode_id % 19 = 0 THEN 'frame_count' END, CASE WHEN episode_id % 23 = 0 THEN 'final_score' END, CASE WHEN episode_id % 29 = 0 THEN 'base_reward' END, CASE WHEN episode_id % 31 = 0 THEN 'event_order' END]) AS rule FROM s) SELECT * FROM v WHERE rule IS NOT NULL""")
def val2_step_ledger(spark, d):
    fr, e = frames(spark, d), F.col("episode_id")
    kinds = F.array_distinct(F.transform(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", "events"))), lambda x: x["events"])), lambda x: x["type"]))
    own = fr.groupBy("episode_id", "step").agg(F.count(L(1)).alias("frames"), F.max_by("score", "idx").alias("score"), F.sum("components.total").alias("base_reward"), kinds.alias("events"))
    told = own.withColumns({"frames": F.col("frames") + (e % 19 == 0).cast("int") * 20, "score": F.col("score") + (e % 23 == 0).cast("int"), "base_reward": F.col("base_reward") + (e % 29 == 0).cast("int"), "events": F.when(e % 31 == 0, F.concat("events", F.array(L("x")))).otherwise(F.col("events")), "death": L(False)})
    return ct.step_ledger(fr, told)


@query(broken_sql(STEPS + ", x AS (SELECT *, episode_id AS k, lag(episode_id % 23 = 0 AND step = 2) OVER (PARTITION BY episode_id ORDER BY step) AS after FROM steps)", "episode_id, idx",
    {"action_order": "k % 11 = 0", "env_step": "k % 13 = 0", "frame_count": "k % 17 = 0", "frame_contiguous": "k % 17 = 0", "score": "k % 19 = 0", "wall": "k % 29 = 0", "ended": "k % 31 = 0"}, "(SELECT *, step AS idx FROM x)"))
def val3_prefix_evidence(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("episode_id").orderBy("step")
    k, step = F.col("episode_id"), F.col("step")
    bad = lambda n: (k % n == 0)
    rows = steps(spark, d).select(
        "episode_id", step.alias("idx"), "action", F.when(bad(11), "S").otherwise(F.col("action")).alias("planned"), (step + bad(13).cast("int")).alias("env_step"), F.sum("delta").over(w).alias("score"), (F.col("delta") + bad(19).cast("int")).alias("score_delta"),
        (step * 16).alias("logic_frame"), F.when(bad(17), 17).otherwise(16).alias("logic_frames"), bad(29).alias("wall"), bad(31).alias("ended"),
    )
    return ct.prefix_evidence(rows)


@query(broken_sql(EPISODES + ", h AS (SELECT *, episode_id AS k, n_steps AS step FROM episodes)", "episode_id, step", {"no_action": "k % 7 = 0", "ended": "k % 11 = 0", "zeros": "k % 13 = 0", "target": "k % 17 = 0", "accumulated": "k % 19 = 0", "adjustment": "k % 23 = 0 OR k % 17 = 0", "shaped": "k % 29 = 0"}, "h"))
def val4_parse_failures(spark, d):
    e = episodes(spark, d).withColumn("k", F.col("episode_id"))
    earned = F.col("k") % 8 / 4
    adjustment = -1.0 - earned + F.when(hit("k", 23), 0.5).otherwise(0.0)
    rows = e.select(
        "episode_id", F.col("n_steps").alias("step"), F.when(hit("k", 7), "U").alias("action"), L(True).alias("terminated"), hit("k", 11).alias("truncated"), L("parse_failed").alias("reason"), F.when(hit("k", 13), 1.0).otherwise(0.0).alias("base"), L(0.0).alias("wall"),
        F.when(hit("k", 17), -2.0).otherwise(-1.0).alias("target"), earned.alias("earned"), (earned + F.when(hit("k", 19), 0.25).otherwise(0.0)).alias("accumulated"), adjustment.alias("adjustment"), (adjustment + F.when(hit("k", 29), 1.0).otherwise(0.0)).alias("shaped"),
    )
    return ct.parse_failures(rows, ["base", "wall"])


@query(broken_sql("h AS (SELECT p_partkey AS k FROM part)", "k", {"distinct": "k % 11 = 0", "covers_mask": "k % 11 = 0 OR k % 13 = 0", "ranks": "k % 17 = 0", "names": "(k % 17 = 0) <> (k % 19 = 0)", "exits": "k % 23 = 0"}, "h"))
def val5_fallback_candidates(spark, d):
    k = F.col("k")
    one = lambda i, a: F.struct(F.concat(L("A"), (L(i) + F.when(hit("k", 19), 1).otherwise(0)).cast("string")).alias("option_id"), a.alias("action"), (L(i + 1) + F.when(hit("k", 17), 1).otherwise(0)).alias("rank"), F.when(hit("k", 23), 5).otherwise(2).alias("exits"))
    # where ranks are off, the names are those of the ranks told
    candidates = F.array(one(1, L("L")), one(0, F.when(hit("k", 11), "L").otherwise("U")))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k")).select("k", candidates.alias("candidates"), F.when(hit("k", 13), F.array(L("U"), L("R"))).otherwise(F.array(L("U"), L("L"))).alias("mask"))
    return ct.fallback_candidates(rows, "k")


@query(f"WITH {STEPS} SELECT episode_id, step FROM steps WHERE episode_id % 10 = 3 AND position = 2")
def val6_prompt_hashes(spark, d):
    """Steps whose recorded prompt hash is not that of the prompt rendered again."""
    prompt = F.format_string("at %s last %s", F.col("position").cast("string"), "action")
    told = F.sha2(F.when((F.col("episode_id") % 10 == 3) & (F.col("position") == 2), F.concat(prompt, L("!"))).otherwise(prompt), 256)
    return reports.stale_hashes(steps(spark, d), told, prompt).select("episode_id", "step")


LEDGER = """r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_partkey AS k, l_partkey % 6 AS kind FROM lineitem)"""


#: A recipe that pays for every event, prices deaths, and shapes the way to the last pellets.
RECIPE = ct.RewardRecipe(normal_pellet=1, power_pellet=2, ghost=3, fruit=4, completion=50, death=20, step=0.05, step_cleared=0.1, wall=0.5, use_base=False, alpha=0.25, threshold=0.5, by_cleared=True, skip_on_eat=True)


def reward_rows(spark, d, recipe: ct.RewardRecipe = RECIPE) -> DataFrame:
    """Rewards of one event each as they should be, and what is recorded of them."""
    k, kind = F.col("k"), F.col("kind")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_partkey").alias("k"), (F.col("l_partkey") % 6).alias("kind"))
    names = ("normal_pellet_eaten", "power_pellet_eaten", "ghost_eaten", "fruit_eaten", "death", "level_cleared")
    delta = F.element_at(F.array(*map(L, (10, 100, 200, 2500, 0, 0))), (kind + 1).cast("int")).cast("long")
    event = F.struct(F.element_at(F.array(*map(L, names)), (kind + 1).cast("int")).alias("type"), delta.alias("delta"))
    counts = {n: (kind == i).cast("int") for i, n in enumerate(recipe.counted)}
    terms = ct.shaped_reward(recipe, base=delta, counts=counts, completed=kind == 5, death=kind == 4, wall=F.col("l_suppkey") % 3 == 0, before=F.when(k % 4 > 0, k % 10), after=k % 7, ratio=(k % 11) / 10)
    return rows.withColumns({"events": F.array(event), "base": delta, "before": F.when(k % 4 > 0, k % 10), "after": k % 7, "ratio": (k % 11) / 10} | terms)


SHAPED = """r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_partkey AS k, l_partkey % 6 AS kind, (l_partkey % 11) / 10 AS ratio, l_suppkey % 3 = 0 AS wall FROM lineitem),
  a AS (SELECT *, ratio <= 0.5 AND k % 4 > 0 AND kind <> 0 AS active FROM r),
  t AS (SELECT *, CASE WHEN active THEN 0.25::DOUBLE * (1 - ratio) ELSE 0 END AS weight, CASE WHEN active THEN 0.25::DOUBLE * (1 - ratio) * (k % 10 - k % 7) ELSE 0 END AS progress FROM a)"""


@query(f"""WITH {SHAPED} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(weight, 6)::DOUBLE AS progress_weight, round(progress, 6)::DOUBLE AS progress_reward, round(CASE kind WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 5 THEN 50 ELSE 0 END - CASE WHEN kind = 4 THEN 20 ELSE 0 END - (0.05::DOUBLE + 0.1::DOUBLE * (1 - ratio)) - CASE WHEN wall THEN 0.5::DOUBLE ELSE 0 END + progress, 6)::DOUBLE AS shaped FROM t""")
def nm12_shaped_rewards(spark, d):
    r = reward_rows(spark, d)
    return r.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *(F.round(c, 6).alias(c) for c in ("progress_weight", "progress_reward", "shaped")))


@query("""WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_partkey AS k, l_partkey % 6 AS kind, (l_partkey % 11) / 10 AS ratio, l_suppkey % 3 = 0 AS wall FROM lineitem),
  a AS (SELECT *, CASE kind WHEN 0 THEN 10 WHEN 1 THEN 100 WHEN 2 THEN 200 WHEN 3 THEN 2500 ELSE 0 END AS base, CASE WHEN ratio <= 0.8 AND k % 4 > 0 THEN 0.5::DOUBLE * (k % 10 - k % 7) ELSE 0 END AS progress FROM r)
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'curriculum.yaml' AS recipe, (CASE kind WHEN 2 THEN 5 WHEN 5 THEN 30 WHEN 4 THEN -100 ELSE 0 END + base - 0.25::DOUBLE - 2 * wall::INT + progress)::DOUBLE AS shaped FROM a
  UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'plain.yaml', (base - 1 - wall::INT)::DOUBLE FROM a""")
def src11_nm12_recipes(spark, d):
    """The rewards of two recipes that are read from YAML files; one has every default."""
    path = sinks.shared_path(spark, "src11")
    put(spark, f"{path}/plain.yaml", "reward: {}\nseeds: [0, 1]\n")
    put(spark, f"{path}/curriculum.yaml", "reward:\n  ghost: 5.0\n  death: 100\n  completion: 30\n  step: 0.25\n  wall: 2\n  alpha: 0.5\n  threshold: 0.8\nseeds: [2]\n")
    settings = readers.yaml_settings(spark, path)
    recipes = {name: ct.RewardRecipe.of(own) for name, own in readers.nested(settings, "reward").items()}  # two files
    parts = [reward_rows(spark, d, recipe).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", L(name).alias("recipe"), F.round("shaped", 6).alias("shaped")) for name, recipe in sorted(recipes.items())]
    return parts[0].unionByName(parts[1])


@query(broken_sql(SHAPED, "l_orderkey, l_partkey, l_suppkey, l_linenumber", {
    "event_count": "k % 101 = 0", "event_score": "k % 97 = 0", "power_pellet_flag": "k % 89 = 0 AND kind <> 1", "death_flag": "k % 83 = 0 AND kind <> 4", "contribution": "k % 79 = 0", "progress": "k % 73 = 0 AND active", "penalties": "k % 71 = 0", "ratio": "k % 67 = 0",
    "shaped": "(k % 89 = 0)::INT + (k % 83 = 0)::INT * -1 + (k % 79 = 0)::INT * 3 + (k % 73 = 0 AND active)::INT * 7 + (k % 71 = 0)::INT * 15 + (k % 61 = 0)::INT * 31 <> 0"}, "t"))
def val7_reward_ledger(spark, d):
    k = F.col("k")
    off = lambda n, x: F.when(k % n == 0, x).otherwise(0)
    r = reward_rows(spark, d)
    active = F.col("progress_weight") > 0
    told = r.withColumns({
        "event_count": 1 + off(101, 1), "base": F.col("base") + off(97, 1), "power_pellet_reward": F.col("power_pellet_reward") + off(89, 1.0), "death_penalty": F.col("death_penalty") + off(83, 1.0), "contribution": F.when(k % 79 == 0, F.lit(3.0)).otherwise(0.0),
        "active": active, "progress_reward": F.col("progress_reward") + F.when((k % 73 == 0) & active, 7.0).otherwise(0.0), "step_penalty": F.col("step_penalty") - off(71, 15.0), "ratio": F.when(k % 67 == 0, 1.5).otherwise(F.col("ratio")), "shaped": F.col("shaped") - off(61, 31.0),
    })
    return ct.reward_ledger(told, "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query(broken_sql("h AS (SELECT o_orderkey AS id, o_orderkey AS k FROM orders)", "id", {"id": "k % 97 = 0", "split": "k % 89 = 0", "contract": "k % 83 = 0", "seed": "k % 79 = 0", "commit": "k % 73 = 0", "dirty": "k % 71 = 0"}, "h"))
def val9_episode_rows(spark, d):
    k = F.col("k")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("seed"))
    rows = rows.withColumns({"name": F.when(hit("k", 97), "").otherwise(F.concat(L("e-"), k)), "split": F.when(hit("k", 89), "dev").otherwise("train"), "contract": F.when(hit("k", 83), "v2").otherwise("v3"), "seed": F.when(hit("k", 79), -1).otherwise(F.col("seed")), "commit": F.when(hit("k", 73), "0").otherwise(F.substring(F.sha2(k.cast("string"), 256), 1, 40)), "dirty": F.when(~hit("k", 71), L(False))})
    return audit.violations(rows, ct.episode_row_rules("v3", ("train", "validation")), "id")


@query(f"""WITH {STEPS}, c AS (SELECT *, sum(delta) OVER (PARTITION BY episode_id ORDER BY step) AS after FROM steps) SELECT episode_id, step FROM c WHERE step > 1 AND position = 3""")
def val10_state_continuity(spark, d):
    from pyspark.sql import Window

    after = F.sum("delta").over(Window.partitionBy("episode_id").orderBy("step"))
    rows = steps(spark, d).withColumn("after", after).withColumn("before", F.col("after") - F.col("delta") + F.when(F.col("position") == 3, 1).otherwise(0))
    return ct.state_continuity(rows, "episode_id", "step", "after", "before")


@query("""SELECT * FROM (VALUES ('extra', 'not listed'), ('nation', 'rows'), ('region', 'digest'), ('supplier', 'missing')) t(name, problem)""")
def val11_bundle(spark, d):
    """Files against a manifest that lists one more, leaves one out, and tells another row count and another digest."""
    def facts(name: str, as_name: str | None = None) -> DataFrame:
        whole = table(spark, d, name)
        return sinks.row_digest(whole.select([c for c in whole.columns if not c.endswith("acctbal")])).select(L(as_name or name).alias("name"), "rows", "digest")

    found = facts("region").unionByName(facts("nation")).unionByName(facts("customer")).unionByName(facts("region", "extra"))
    told = facts("region").withColumn("digest", L("0")).unionByName(facts("nation").withColumn("rows", F.col("rows") + 1)).unionByName(facts("customer")).unionByName(facts("supplier"))
    return ct.verified_files(found, told)


@query("""SELECT c_custkey AS id, 'seed' AS key, c_custkey::VARCHAR AS before, (c_custkey + 1)::VARCHAR AS after FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey, 'actor.lr', '1', NULL FROM customer WHERE c_custkey % 15 = 0""")
def val13_config_drift(spark, d):
    from ..operators.records import drifted, flattened

    c = table(spark, d, "customer")
    i = F.col("c_custkey")
    conf = lambda seed, lr, path: F.struct(F.struct(L(path).alias("path"), lr.alias("lr")).alias("actor"), seed.alias("seed"))
    key = lambda df: flattened(df, "id", "config").select(F.concat_ws(":", "id", "key").alias("key"), "value")
    before = key(c.select(i.alias("id"), conf(i, L("1"), "a").alias("config")))
    after = key(c.select(i.alias("id"), conf(i + (i % 10 == 0).cast("int"), L("1"), "b").alias("config"))).where(~((F.split_part("key", L(":"), L(1)).cast("long") % 15 == 0) & F.col("key").endswith("actor.lr")))
    name = F.split_part("key", L(":"), L(2))
    found = drifted(before.where(name != "actor.path"), after.where(name != "actor.path"))
    return found.select(F.split_part("key", L(":"), L(1)).cast("long").alias("id"), name.alias("key"), "before", "after")


@query(broken_sql("h AS (SELECT p_partkey AS k FROM part)", "k", {"count": "k % 11 = 0", "ticks": "k % 13 = 0", "events": "k % 17 = 0"}, "h"))
def val16_mode_rules(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    rows = rows.select("k", hit("k", 11).cast("int").alias("ghosts"), hit("k", 13).cast("int").alias("ticks"), F.when(hit("k", 17), F.array(L("pellet"), L("death"))).otherwise(F.array(L("pellet"))).alias("events"))
    return audit.violations(rows, ct.mode_rules("disabled"), "k")


@query(f"""WITH {STEPS}, n AS (SELECT episode_id, max(step) AS m FROM steps GROUP BY 1), s AS (SELECT episode_id, step AS place, CASE WHEN episode_id % 11 = 0 THEN ['action'] ELSE []::VARCHAR[] END AS a, CASE WHEN episode_id % 13 = 0 THEN ['cell'] ELSE []::VARCHAR[] END AS c, CASE WHEN episode_id % 17 = 0 THEN ['called'] ELSE []::VARCHAR[] END AS m FROM steps JOIN n USING (episode_id) WHERE NOT (episode_id % 19 = 0 AND step = n.m)),
  v AS (SELECT episode_id, place, unnest(list_concat(list_concat(a, c), m)) AS rule FROM s) SELECT * FROM v UNION ALL SELECT episode_id, m, unnest(['both', 'action', 'cell', 'called']) FROM n WHERE episode_id % 19 = 0""")
def val17_route_binding(spark, d):
    from pyspark.sql import Window

    k = F.col("episode_id")
    s = steps(spark, d)
    own = s.select("episode_id", F.col("step").alias("at"), "action", F.col("position").alias("cell"), (F.col("step") % 3 == 1).alias("called"))
    last = F.col("at") == F.max("at").over(Window.partitionBy("episode_id"))
    executed = own.select("episode_id", (F.col("at") * 10).alias("at"), F.when(k % 11 == 0, "S").otherwise(F.col("action")).alias("action"), (F.col("cell") + (k % 13 == 0).cast("int")).alias("cell"), ((F.col("at") + 2) % 3 + F.when(k % 17 == 0, F.when(F.col("called"), 1).otherwise(-((F.col("at") + 2) % 3))).otherwise(0)).alias("cursor"))
    executed = executed.withColumn("last", last).where(~((k % 19 == 0) & F.col("last"))).drop("last")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(2 * table(spark, d, "lineitem").count() / TASK_ROWS))
    return ct.route_binding(own, executed, "episode_id", parts).select("episode_id", F.col("place").cast("long").alias("place"), "rule")


@query(broken_sql(EPISODES + ", h AS (SELECT *, episode_id AS k FROM episodes)", "episode_id", {"start": "k % 11 = 0", "steps": "k % 13 = 0", "fault": "fault AND k % 5 = 0", "outcome": "NOT fault AND k % 17 = 0", "reward": "NOT fault AND k % 19 = 0"}, "h"))
def val18_attempt_contract(spark, d):
    from ..functions.statistics import budget_reward

    e = episodes(spark, d).withColumn("k", F.col("episode_id"))
    source = F.when(F.col("k") % 3 == 0, L(0)).otherwise(F.col("seed") + 1)
    normal = (F.col("k") % 3 == 0) != hit("k", 11)
    e = e.withColumns({"source_step": source, "start": F.when(normal, "normal").otherwise("restart"), "steps": F.when(hit("k", 13), 2000).otherwise(F.col("n_steps")), "won": (F.col("terminal") == "cleared") & ~F.col("fault")})
    reward = budget_reward(F.col("won"), F.col("source_step"), F.col("steps"), 0.1, 1000) + F.when(hit("k", 19), 0.25).otherwise(0.0)
    rows = e.withColumns({"fault_code": F.when(F.col("fault") | hit("k", 17), "timeout"), "trainable": ~F.col("fault"), "reward": F.when(~F.col("fault") | hit("k", 5), reward)})
    return audit.violations(rows, ct.attempt_rules(1000, 0.1), "episode_id")


@query(broken_sql("h AS (SELECT p_partkey AS k FROM part)", "k", {"support": "k % 11 = 0", "action": "k % 13 = 0", "sum": "k % 17 = 0", "chosen": "k % 19 = 0 OR k % 13 = 0", "weight": "k % 23 = 0"}, "h"))
def val19_decision_evidence(spark, d):
    k = F.col("k")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    logp = F.transform(F.array(L(0.5), L(0.25), F.when(k % 17 == 0, 0.5).otherwise(0.25)), lambda x: F.log(x))
    rows = rows.select("k", F.when(k % 11 == 0, F.array(L(7), L(8), L(8))).otherwise(F.array(L(7), L(8), L(9))).alias("support"), logp.alias("logp"), F.when(k % 13 == 0, 1).otherwise(8).alias("action"), F.log(F.when(k % 19 == 0, 0.5).otherwise(0.25)).alias("chosen_logp"), F.when(k % 23 == 0, 2.5).otherwise(1.0).alias("weight"))
    return audit.violations(rows, ct.decision_rules(), "k")


@query(f"""WITH {EPISODES}, b AS (SELECT group_id // 16 AS update, group_id, n_steps, 'v' || (group_id // 48 + (group_id % 500 = 3)::INT) AS version FROM episodes), g AS (SELECT update, group_id, count(*) AS n, min(n_steps) < max(n_steps) AS spread, min(version) AS v, max(version) AS w FROM b GROUP BY 1, 2)
  SELECT update, sum(n)::BIGINT AS rows, count(*) AS groups, count(*) FILTER (n <> 12) AS odd, count(*) FILTER (NOT spread) AS flat, min(v) = max(w) AS one_version, count(*) = 16 AND count(*) FILTER (n <> 12) = 0 AND count(*) FILTER (NOT spread) = 0 AND min(v) = max(w) AS passed FROM g GROUP BY 1""")
def val20_update_gate(spark, d):
    e, g = episodes(spark, d), F.col("group_id")
    version = F.concat(L("v"), (F.expr("group_id div 48") + (g % 500 == 3).cast("int")).cast("string"))
    return ct.update_gate(e.select(F.expr("group_id div 16").alias("update"), "group_id", F.col("n_steps").alias("reward"), version.alias("version")), 16, 12, "update")


@query(broken_sql("h AS (SELECT s_suppkey AS k FROM supplier)", "k", {"total": "k % 7 = 0", "train_ids": "k % 11 = 0", "test_ids": "k % 13 = 0", "train_validation": "k % 3 = 0", "validation_test": "k % 5 = 0"}, "h"))
def val21_protocol_splits(spark, d):
    k = F.col("k")
    one = lambda *ids: F.array(*(F.concat(L(i), k) for i in ids))
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")).select(
        "k", L(16).alias("groups"), L(12).alias("samples"), (L(192) + hit("k", 7).cast("int")).alias("attempts"), F.when(hit("k", 11), one("a", "a")).otherwise(one("a", "b")).alias("train"),
        F.concat(one("c"), F.when(hit("k", 3), one("a")).otherwise(one("d")), F.when(hit("k", 5), one("z")).otherwise(one("e"))).alias("validation"), F.when(hit("k", 13), one("z", "z")).otherwise(one("z", "y")).alias("test"),
    )
    return audit.violations(rows, ct.protocol_rules("attempts", ("groups", "samples"), ("train", "validation", "test")), "k")


@query(f"""WITH {EPISODES}, g AS (SELECT group_id FROM episodes GROUP BY 1 HAVING count(*) = 12), r AS (SELECT episode_id, group_id, CASE WHEN terminal = 'cleared' THEN 1.0::DOUBLE + (episode_id % 4) / 40 ELSE 0.0::DOUBLE END AS reward FROM episodes SEMI JOIN g USING (group_id))
  SELECT group_id, episode_id, round(CASE WHEN min(reward) OVER w = max(reward) OVER w THEN 0 ELSE reward - avg(reward) OVER w END, 6)::DOUBLE AS advantage FROM r WINDOW w AS (PARTITION BY group_id)""")
def nm10_post_processed(spark, d):
    e = episodes(spark, d)
    whole = e.groupBy("group_id").agg(F.count(L(1)).alias("_n")).where("_n = 12").select("group_id")
    e = e.join(whole, "group_id", "left_semi").withColumn("reward", F.when(F.col("terminal") == "cleared", 1.0 + F.col("episode_id") % 4 / 40).otherwise(0.0))
    n = F.when(F.col("reward") == 0, F.col("episode_id") % 3).otherwise(F.col("episode_id") % 3 + 1)
    places = F.when(n > 0, F.sequence(L(0).cast("long"), n - 1)).otherwise(F.array(L(-1).cast("long")))
    samples = e.select("group_id", "episode_id", "reward", L("v1").alias("version"), F.col("group_id").alias("state"), n.alias("decisions"), F.explode(places).alias("place"))
    return ct.post_processed(samples).withColumn("advantage", F.round("advantage", 6))
