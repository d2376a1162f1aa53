"""Rule tables of recorded episodes: headers, ledgers of frames and events, rewards, options, decisions, batches."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .audit import Rule, violations

#: Score an event may bring, by type; the component it counts for; bounds of frames in a step (fixed values).
SCORES = {"normal_pellet_eaten": (10,), "power_pellet_eaten": (100,), "ghost_eaten": (200, 400, 800, 1600), "fruit_eaten": (2500,), "death": (0,), "level_cleared": (0,)}
COMPONENTS = {"normal_pellet_eaten": "normal_pellet", "power_pellet_eaten": "power_pellet", "ghost_eaten": "ghost", "fruit_eaten": "fruit", "death": "other", "level_cleared": "other"}
NAMES = ("normal_pellet", "power_pellet", "ghost", "fruit", "other")
LEAST_FRAMES, MOST_FRAMES, MOST_RESPAWN_FRAMES = 1, 16, 256
#: Terminal reasons that an episode may end with (fixed values).
REASONS = ("all_normal_pellets", "death", "game_over", "max_steps", "parse_failed", "safety_refusal")
TOLERANCE = 1e-9


def col(name: str) -> Column:
    return F.col(name)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def near(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    return F.abs(a - b) <= tolerance


def hexadecimal(c: Column, length: int) -> Column:
    return c.rlike(f"^[0-9a-f]{{{length}}}$")


def fails(name: str, holds: Column) -> Rule:
    return Rule(name, ~F.coalesce(holds, F.lit(False)))


def header_rules(max_steps: tuple[int, ...]) -> list[Rule]:
    """What a header must fulfil by itself and against its steps' sums (seen_steps, seen_shaped, seen_base, seen_failures, seen_deaths) and last step (last_*)."""
    return [
        fails("api_version", col("api_version") == "v3"),
        fails("backend", col("backend").isin("slow", "fast")),
        fails("commit", hexadecimal(col("commit"), 40)),
        fails("revision", col("revision") == col("commit")),
        fails("renderer", col("renderer") == F.concat(F.lit("renderer:"), col("commit"))),
        fails("ruleset", hexadecimal(col("ruleset"), 64)),
        fails("level", hexadecimal(col("level"), 64)),
        fails("max_steps", col("max_steps").isin(*max_steps)),
        fails("refusal_coefficient", finite(col("refusal_coefficient")) & (col("refusal_coefficient") >= 0)),
        fails("violation_return", near(col("violation_return"), F.lit(-1.0))),
        fails("life_mode", col("life_mode").isin("single_death", "three_lives")),
        fails("reason", col("reason").isin(*REASONS)),
        fails("steps", col("steps") == col("seen_steps")),
        fails("shaped_total", near(col("shaped_total"), col("seen_shaped"))),
        fails("base_total", near(col("base_total"), col("seen_base"))),
        fails("parse_failures", col("parse_failures") == col("seen_failures")),
        fails("death_count", col("death_count") == col("seen_deaths")),
        fails("ended", col("last_terminated") | col("last_truncated")),
        fails("flags", (col("terminated") == col("last_terminated")) & (col("truncated") == col("last_truncated"))),
        fails("final_score", col("final_score") == col("last_score")),
        fails("pellets", col("pellets_initial") - col("last_remaining") == col("pellets_eaten")),
        fails("won", col("won") == ((col("reason") == "all_normal_pellets") & (col("last_remaining") == 0))),
        fails("parse_end", (col("reason") != "parse_failed") | ((col("parse_failures") == 1) & near(col("seen_shaped"), col("violation_return")))),
        fails("refusal_end", (col("reason") != "safety_refusal") | (col("truncated") & ~col("terminated"))),
    ]


def step_rules() -> list[Rule]:
    """Steps (step, place, action, terminated, truncated, last, lives, lives_after, score_before, score, death, deaths_before, death_count, parse_failed) one by one."""
    from ..functions.scalar import lives_after

    return [
        fails("step", col("step") == col("place")),
        fails("action", col("parse_failed") | col("action").isin("U", "D", "L", "R", "S")),
        fails("after_end", col("last") | ~(col("terminated") | col("truncated"))),
        fails("lives", (col("lives") >= 0) & (col("lives_after") == lives_after(col("lives"), col("score_before"), col("score"), col("death")))),
        fails("deaths", col("death_count") == col("deaths_before") + col("death").cast("int")),
    ]


def ledger(frames: DataFrame) -> DataFrame:
    """(episode_id, step, rule) broken by frames (episode_id, step, idx, frame, score, delta, components, events) and what a step records of them.

    components is a struct of NAMES and total, events an array of (type, delta, idx, frame). Frames count on
    over the whole episode, but stand still in a step after a death.
    """
    order = [col("step"), col("idx")]
    w = Window.partitionBy("episode_id").orderBy(*order)
    inner = Window.partitionBy("episode_id", "step").orderBy("idx")
    died = F.exists("events", lambda e: e["type"] == "death")
    rows = frames.withColumns({
        "_frame": F.coalesce(F.lag("frame").over(w), F.lit(0)), "_score": F.coalesce(F.lag("score").over(w), F.lit(0)), "_place": F.row_number().over(inner),
        "_dead": F.coalesce(F.max(died.cast("int")).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0,
    })
    total = sum((col("components")[n] for n in NAMES), F.lit(0))
    event_sum = lambda name: F.aggregate(F.filter("events", lambda e: F.lit(True) if name is None else _component(e["type"]) == name), F.lit(0).cast("long"), lambda s, e: s + e["delta"])
    rules = [
        fails("frame_index", col("idx") == col("_place")),
        fails("frame_contiguous", col("frame") == F.when(col("_dead"), col("_frame")).otherwise(col("_frame") + 1)),
        fails("score_delta", col("score") - col("_score") == col("delta")),
        fails("components", (col("components")["total"] == col("delta")) & (total == col("delta"))),
        fails("event_type", F.forall("events", lambda e: e["type"].isin(*SCORES))),
        fails("event_value", F.forall("events", lambda e: _legal(e["type"], e["delta"]))),
        fails("event_frame", F.forall("events", lambda e: (e["idx"] == col("idx")) & (e["frame"] == col("frame")))),
        fails("event_score", event_sum(None) == col("delta")),
        *(fails(f"event_{n}", event_sum(n) == col("components")[n]) for n in NAMES),
        fails("one_death", ~col("_dead") | ~died),
    ]
    return violations(rows, rules, "episode_id", "step").distinct()


def _component(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in COMPONENTS.items()))


def _legal(kind: Column, delta: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, delta.isin(*v)) for k, v in SCORES.items()), F.lit(False))


def step_ledger(frames: DataFrame, steps: DataFrame, life_mode: str = "single_death") -> DataFrame:
    """(episode_id, step, rule) where a step (frames, score, base_reward, events, death) differs from the sums of its frames."""
    flat = frames.groupBy("episode_id", "step").agg(
        F.count(F.lit(1)).alias("_frames"), F.max_by("score", "idx").alias("_score"), F.sum(col("components")["total"]).alias("_total"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", "events"))), lambda x: x["events"])).alias("_events"),
    )
    most = F.when(col("death") & F.lit(life_mode == "three_lives"), MOST_RESPAWN_FRAMES).otherwise(MOST_FRAMES)
    rules = [
        fails("frame_count", (col("frames") == col("_frames")) & col("frames").between(LEAST_FRAMES, most)),
        fails("final_score", col("score") == col("_score")),
        fails("base_reward", col("base_reward") == col("_total")),
        fails("event_order", col("events") == F.array_distinct(F.transform("_events", lambda e: e["type"]))),
    ]
    return violations(steps.join(flat, ["episode_id", "step"], "left"), rules, "episode_id", "step")


def prefix_evidence(rows: DataFrame) -> DataFrame:
    """(episode_id, idx, rule) of a prefix's evidence (episode_id, idx, planned, action, env_step, score, score_delta, logic_frame, logic_frames, wall, ended)."""
    w = Window.partitionBy("episode_id").orderBy("idx")
    before = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0))
    own = rows.withColumns({"_score": before("score"), "_frame": before("logic_frame")})
    rules = [
        fails("action_order", col("action") == col("planned")),
        fails("movement", col("action").isin("U", "D", "L", "R")),
        fails("env_step", col("env_step") == col("idx")),
        fails("frame_count", col("logic_frames").between(LEAST_FRAMES, MOST_FRAMES)),
        fails("frame_contiguous", col("logic_frame") == col("_frame") + col("logic_frames")),
        fails("score", col("score") == col("_score") + col("score_delta")),
        fails("wall", ~col("wall")),
        fails("ended", ~col("ended")),
    ]
    return violations(own, rules, "episode_id", "idx")


def parse_failures(rows: DataFrame, zeros: list[str]) -> DataFrame:
    """(episode_id, step, rule) of parse-failure records: no action, an ended step, nothing earned, and an adjustment that brings the return to its target."""
    rules = [
        fails("no_action", col("action").isNull()),
        fails("ended", col("terminated") & ~col("truncated") & (col("reason") == "parse_failed")),
        fails("zeros", sum((F.coalesce(F.abs(col(z)), F.lit(1)) for z in zeros), F.lit(0.0)) == 0),
        fails("target", near(col("target"), F.lit(-1.0))),
        fails("accumulated", near(col("accumulated"), col("earned"))),
        fails("adjustment", finite(col("adjustment")) & near(col("adjustment"), col("target") - col("earned"))),
        fails("shaped", near(col("shaped"), col("adjustment"))),
    ]
    return violations(rows, rules, "episode_id", "step")


def fallback_candidates(rows: DataFrame, key: str) -> DataFrame:
    """(key, rule) of candidate lists (option_id, action, rank, exits) against the mask of open moves: one candidate a move, ranks 1..n, each named by its rank."""
    c = "candidates"
    actions = F.transform(c, lambda x: x["action"])
    ranks = F.array_sort(F.transform(c, lambda x: x["rank"]))
    rules = [
        fails("size", F.size(c).between(1, 4)),
        fails("distinct", F.size(F.array_distinct(actions)) == F.size(c)),
        fails("covers_mask", F.array_sort(F.array_distinct(actions)) == F.array_sort("mask")),
        fails("ranks", ranks == F.sequence(F.lit(1), F.size(c))),
        fails("names", F.forall(c, lambda x: x["option_id"] == F.concat(F.lit("A"), (x["rank"] - 1).cast("string")))),
        fails("exits", F.forall(c, lambda x: x["exits"].between(0, 4))),
    ]
    return violations(rows, rules, key)


@dataclass(frozen=True)
class RewardRecipe:
    """Coefficients of the shaped reward: gains a event (`counted`), for completion, prices of a step (more with what is cleared), a wall and a
    death, and of progress to the nearest pellet once no more than `threshold` of the pellets is left. By default a step costs 1, a wall 1, and the game's score counts."""

    normal_pellet: float = 0.0
    power_pellet: float = 0.0
    ghost: float = 0.0
    fruit: float = 0.0
    completion: float = 0.0
    death: float = 0.0
    step: float = 1.0
    step_cleared: float = 0.0
    wall: float = 1.0
    use_base: bool = True
    alpha: float = 0.0
    threshold: float = 1.0
    by_cleared: bool = False
    skip_on_eat: bool = False

    counted = ("normal_pellet", "power_pellet", "ghost", "fruit")

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if f.type == "bool" and not isinstance(value, bool) or f.type == "float" and (isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value)):
                raise ValueError(f"{f.name} is {value!r}")

    @classmethod
    def of(cls, settings: dict) -> RewardRecipe:
        """The recipe of a mapping of names; names it doesn't have keep their defaults, unknown ones are an error."""
        if unknown := set(settings) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown coefficients: {', '.join(sorted(unknown))}")
        return cls(**settings)


def shaped_reward(recipe: RewardRecipe, *, base: Column, counts: dict[str, Column], completed: Column, death: Column, wall: Column, before: Column, after: Column, ratio: Column, ratio_before: Column | None = None) -> dict[str, Column]:
    """The terms of the shaped reward and their sum: events by how often they happened, completion and death, a step's price, walls, and progress to the nearest
    pellet (if both distances are known and the recipe doesn't pass over steps that eat one)."""
    ratio = F.when(ratio.between(0, 1), ratio).otherwise(F.raise_error(F.lit("the share of pellets left is not in [0, 1]")).cast("double"))
    active = F.coalesce((ratio <= recipe.threshold) & before.isNotNull() & after.isNotNull(), F.lit(False)) & F.lit(recipe.alpha > 0)
    if recipe.skip_on_eat:
        active = active & (counts["normal_pellet"] == 0)
    weight = F.when(active, F.lit(float(recipe.alpha)) * (1.0 - ratio) if recipe.by_cleared else F.lit(float(recipe.alpha))).otherwise(F.lit(0.0))
    price = lambda happened, amount: F.when(happened, float(amount)).otherwise(0.0)
    terms = {f"{n}_reward": counts[n] * F.lit(float(getattr(recipe, n))) for n in recipe.counted}
    terms["completion_reward"] = price(completed, recipe.completion)
    terms["death_penalty"] = price(death, recipe.death)
    terms["step_penalty"] = float(recipe.step) + float(recipe.step_cleared) * (1.0 - (ratio if ratio_before is None else ratio_before))
    terms["wall_penalty"] = price(wall, recipe.wall)
    terms["progress_weight"] = weight
    terms["progress_reward"] = F.when(active, weight * (before - after)).otherwise(F.lit(0.0))
    gains = sum((v for k, v in terms.items() if k.endswith("_reward")), base if recipe.use_base else F.lit(0.0))
    terms["shaped"] = gains - terms["step_penalty"] - terms["wall_penalty"] - terms["death_penalty"]
    return terms


def reward_ledger(rows: DataFrame, *key: str) -> DataFrame:
    """(key, rule) of recorded rewards: event counts and sums, a flag and a term only with its event, progress as distance times weight, and the shaped reward as the sum of its terms."""
    gains = ("normal_pellet", "power_pellet", "ghost", "fruit")
    expected = col("contribution") + sum((col(f"{g}_reward") for g in gains), F.lit(0.0)) + col("completion_reward") - col("step_penalty") - col("wall_penalty") - col("death_penalty") + col("progress_reward")
    active = F.when(col("active"), near(col("progress_reward"), col("progress_weight") * (col("before") - col("after")))).otherwise((col("progress_reward") == 0) & (col("progress_weight") == 0))
    rules = [
        fails("event_count", col("event_count") == F.size("events")),
        fails("event_value", F.forall("events", lambda e: _legal(e["type"], e["delta"]))),
        fails("event_score", F.aggregate("events", F.lit(0).cast("long"), lambda s, e: s + e["delta"]) == col("base")),
        *(fails(f"{g}_flag", (col(f"{g}_reward") >= 0) & (_has(g) | (col(f"{g}_reward") == 0))) for g in gains),
        fails("death_flag", _has("death") | (col("death_penalty") == 0)),
        fails("contribution", (F.abs(col("contribution")) <= TOLERANCE) | near(col("contribution"), col("base"))),
        fails("progress", active),
        fails("penalties", finite(col("step_penalty")) & (col("step_penalty") >= 0) & finite(col("wall_penalty")) & (col("wall_penalty") >= 0)),
        fails("ratio", col("ratio").between(0, 1)),
        fails("shaped", finite(col("shaped")) & near(col("shaped"), expected)),
    ]
    return violations(rows, rules, *key)


def _has(kind: str) -> Column:
    kinds = [k for k, v in COMPONENTS.items() if v == kind or k == kind]
    return F.exists("events", lambda e: e["type"].isin(*kinds))


def state_continuity(rows: DataFrame, key: str, order: str, after: str, before: str) -> DataFrame:
    """(key, order) of records whose state before is not the state after the record that precedes them."""
    w = Window.partitionBy(key).orderBy(order)
    own = rows.withColumns({"_was": F.lag(after).over(w), "_first": F.lag(order).over(w).isNull()})
    return own.where(~F.col("_first") & ~F.col("_was").eqNullSafe(F.col(before))).select(key, order)


def route_binding(steps: DataFrame, executed: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """(key, place, rule): the i-th executed event belongs to the i-th step; action and cell agree, cursor 0 is where the model was called, and neither side has more.

    Both sides are one table dealt by key, once, to `parts` partitions; a task sorts it by side to number it and by place to pair it.
    """
    one = steps.select(key, F.lit(0).alias("_side"), "at", F.struct("action", "cell", "called").alias("_step"))
    two = executed.select(key, F.lit(1).alias("_side"), "at", F.struct("action", "cell", "cursor").alias("_event"))
    both = one.unionByName(two, allowMissingColumns=True)
    both = both.repartition(parts, key) if parts else both.repartition(key)
    placed = both.withColumn("place", F.row_number().over(Window.partitionBy(key, "_side").orderBy("at")))
    # a null key is no episode: its rows are paired with none
    pair = Window.partitionBy(key, "place", F.when(F.col(key).isNull(), F.col("_side"))).orderBy("_side")
    bound = placed.withColumns({"_first": F.row_number().over(pair) == 1, "_event": F.coalesce("_event", F.lead("_event").over(pair))}).where("_first")
    s, e = (lambda x: col(f"_step.{x}")), (lambda x: col(f"_event.{x}"))
    rules = [fails("both", col("_step").isNotNull() & col("_event").isNotNull()), fails("action", s("action") == e("action")), fails("cell", s("cell") == e("cell")), fails("called", s("called") == (e("cursor") == 0))]
    return violations(bound, rules, key, "place")


def attempt_rules(horizon: int, bonus: float) -> list[Rule]:
    """Attempts of a source-bound batch: typed facts, normal or restart told truly, a fault without reward, and a reward that is exactly what the outcome gives."""
    from ..functions.statistics import budget_reward

    normal = col("start") == "normal"
    expected = budget_reward(col("won"), col("source_step"), col("steps"), bonus, horizon)
    return [
        fails("start", col("start").isin("normal", "restart") & (normal == (col("source_step") == 0))),
        fails("source_step", col("source_step").between(0, horizon - 1)),
        fails("steps", col("steps").between(0, horizon - col("source_step"))),
        fails("fault", ~col("fault") | (col("fault_code").isNotNull() & col("reward").isNull() & ~col("trainable") & ~col("won"))),
        fails("outcome", col("fault") | (col("fault_code").isNull() & col("trainable"))),
        fails("reward", col("fault") | (col("reward") == expected)),
    ]


def decision_rules(cap: float = 2.0) -> list[Rule]:
    """A decision's evidence (support, logp, action, chosen_logp, weight): distinct support with the action, probabilities that sum to 1, the chosen one's log-probability, weight in [0, cap]."""
    at = F.array_position("support", col("action"))
    return [
        fails("support", (F.size("support") > 0) & (F.size(F.array_distinct("support")) == F.size("support"))),
        fails("action", at > 0),
        fails("sum", (F.size("logp") == F.size("support")) & near(F.aggregate("logp", F.lit(0.0), lambda s, x: s + F.exp(x)), F.lit(1.0), 1e-5)),
        fails("chosen", near(F.get("logp", (at - 1).cast("int")), col("chosen_logp"), 1e-5)),
        fails("weight", col("weight").between(0.0, cap)),
    ]


def update_gate(batch: DataFrame, groups: int, size: int, *by: str) -> DataFrame:
    """One row, or one for each update (`by`): rows, groups, groups of the wrong size or with one reward, versions, and whether all is as it must be."""
    per = batch.groupBy(*by, "group_id").agg(F.count(F.lit(1)).alias("n"), (F.min("reward") < F.max("reward")).alias("spread"), F.min("version").alias("v"), F.max("version").alias("w"))
    found = per.groupBy(*by).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") != size).alias("odd"), F.count_if(~F.col("spread")).alias("flat"), (F.min("v") == F.max("w")).alias("one_version"))
    return found.withColumn("passed", (F.col("groups") == groups) & (F.col("odd") == 0) & (F.col("flat") == 0) & F.col("one_version"))


def protocol_rules(total: str, parts: tuple[str, str], splits: tuple[str, ...]) -> list[Rule]:
    """A protocol's numbers multiply to its total, and its splits (arrays) are not empty, hold no id twice and share none."""
    out = [fails("total", col(parts[0]) * col(parts[1]) == col(total))]
    out += [fails(f"{s}_ids", (F.size(s) > 0) & (F.size(F.array_distinct(s)) == F.size(s))) for s in splits]
    out += [fails(f"{a}_{b}", ~F.arrays_overlap(a, b)) for i, a in enumerate(splits) for b in splits[i + 1 :]]
    return out


def mode_rules(expected: str) -> list[Rule]:
    """States of a run without adversaries have none, no vulnerability, and no event of theirs; in a normal run there are four."""
    if expected == "disabled":
        return [fails("count", col("ghosts") == 0), fails("ticks", col("ticks") == 0), fails("events", ~F.arrays_overlap("events", F.array(F.lit("ghost_eaten"), F.lit("death"))))]
    return [fails("count", col("ghosts") == 4), fails("ticks", col("ticks") >= 0)]


def verified_files(found: DataFrame, told: DataFrame) -> DataFrame:
    """(name, problem) of files (name, rows, digest) against their manifest: missing, not listed, other rows, other digest."""
    a, b = found.select("name", F.col("rows").alias("_r"), F.col("digest").alias("_d")), told.select("name", "rows", "digest")
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), "name", "full")
    problem = F.when(col("_a").isNull(), "missing").when(col("_b").isNull(), "not listed").when(col("_r") != col("rows"), "rows").when(col("_d") != col("digest"), "digest")
    return both.select("name", problem.alias("problem")).where("problem IS NOT NULL")


def post_processed(samples: DataFrame, size: int = 12) -> DataFrame:
    """(group_id, episode_id, advantage) of decisions (group_id, episode_id, reward, version, state, decisions, place), checked and centred.

    A group of another size, of several initial states or with an episode in two groups, an episode with two
    rewards or with decisions missing or repeated, a reward without a decision, and more than one weight version are errors.
    """
    e = samples.groupBy("episode_id").agg(
        F.min("group_id").alias("group_id"), F.max("group_id").alias("_g"), F.min("reward").alias("reward"), F.max("reward").alias("_r"), F.min("state").alias("state"), F.max("state").alias("_s"),
        F.max("decisions").alias("n"), F.count(F.lit(1)).alias("_rows"), F.count_distinct("place").alias("_places"), F.min("place").alias("_low"), F.max("place").alias("_high"), F.min("version").alias("version"), F.max("version").alias("_v"),
    )
    whole = F.when(col("n") > 0, (col("_rows") == col("n")) & (col("_places") == col("n")) & (col("_low") == 0) & (col("_high") == col("n") - 1)).otherwise((col("_rows") == 1) & (col("_low") == -1) & (col("reward") == 0))
    fine = (col("group_id") == col("_g")) & (col("reward") == col("_r")) & (col("state") == col("_s")) & whole
    e = e.withColumn("reward", F.when(fine, col("reward")).otherwise(F.raise_error(F.concat(F.lit("inconsistent episode "), col("episode_id").cast("string")))))
    g = e.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("state").alias("_states"), F.avg("reward").alias("_mean"), (F.min("reward") == F.max("reward")).alias("_flat"), F.min("version").alias("_v0"), F.max("_v").alias("_v1"))
    versions = g.agg(F.min("_v0").alias("_first"), F.max("_v1").alias("_last"))
    g = g.crossJoin(F.broadcast(versions))  # one row
    ok = (col("_n") == size) & (col("_states") == 1) & (col("_first").eqNullSafe(col("_last")))
    g = g.select("group_id", F.when(ok, col("_mean")).otherwise(F.raise_error(F.concat(F.lit("incomplete group or mixed versions: "), col("group_id").cast("string")))).alias("_mean"), "_flat")
    return e.select("group_id", "episode_id", "reward").join(g, "group_id").select("group_id", "episode_id", F.when(col("_flat"), F.lit(0.0)).otherwise(col("reward") - col("_mean")).alias("advantage"))


def episode_row_rules(contract: str, splits: tuple[str, ...]) -> list[Rule]:
    """Rows of an episode table: a name, a known split, the contract asked for, a seed that is not negative, a whole commit, and whether the tree was dirty."""
    return [
        fails("id", col("name") != ""), fails("split", col("split").isin(*splits)), fails("contract", col("contract") == contract), fails("seed", col("seed") >= 0),
        fails("commit", hexadecimal(col("commit"), 40)), fails("dirty", col("dirty").isNotNull()),
    ]
