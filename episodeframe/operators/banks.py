"""Banks of restart states and collection rounds: what is kept, what goes, what is drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import filled, numbered, running
from .selection import first_of, latest_union, round_robin


def refreshed(old: DataFrame, new: DataFrame, update: int, *, max_age: int = 20, cap: int = 64) -> DataFrame:
    """The bank after an update, from entries (id, tier, lookback, admitted): new ones come in at this update and replace those of
    their id, old ones leave after max_age updates, and each tier keeps `cap`, one of each lookback in turn, newest first."""
    every = latest_union(old, new.withColumn("admitted", F.lit(update).cast("long")), "id")
    fresh = every.where(F.col("admitted") >= update - max_age)
    return round_robin(fresh, "tier", "lookback", [F.col("admitted").desc(), F.col("id").desc()], cap)


def evicted(bank: DataFrame, *, per_bucket: int = 4, per_seed: int = 16) -> DataFrame:
    """(state_id, reason) of the entries (state_id, bucket, seed, usage, last_probe) beyond the capacity of their bucket, or of what is
    left then, of their seed. The most used go first, then those probed longest ago, then by id."""
    order = [F.col("usage"), F.col("last_probe").desc_nulls_last(), F.col("state_id").desc()]
    # what stays is short: each task keeps a key's capacity before anything is shuffled, however full a key is
    first = first_of(bank, ["bucket"], *order, k=per_bucket).drop("place")
    left = first_of(first, ["seed"], *order, k=per_seed)
    out = bank.join(first.select("state_id"), "state_id", "left_anti").select("state_id", F.lit("bucket").alias("reason"))
    return out.unionByName(first.join(left.select("state_id"), "state_id", "left_anti").select("state_id", F.lit("seed").alias("reason")))


def accepted(probes: DataFrame, *, first: int = 8, more: int = 16, low: int = 3, high: int = 21) -> DataFrame:
    """(state_id, probes, wins, accepted) of probe outcomes (state_id, n, won) in order n from 0: `first` probes decide whether `more` follow
    (neither all nor none won), and a state is taken if `low` to `high` of all are won. Probes beyond that are not counted."""
    counted = probes.where(F.col("n") < first + more)
    early = F.col("n") < first
    per = counted.groupBy("state_id").agg(
        F.count_if(early).alias("_first"), F.count_if(early & F.col("won")).alias("_early"), F.count(F.lit(1)).alias("_all"), F.count_if("won").alias("_wins")
    )
    goes_on = (F.col("_early") > 0) & (F.col("_early") < F.col("_first"))
    return per.select(
        "state_id",
        F.when(goes_on, F.col("_all")).otherwise(F.col("_first")).alias("probes"),
        F.when(goes_on, F.col("_wins")).otherwise(F.col("_early")).alias("wins"),
        (goes_on & (F.col("_all") == first + more) & F.col("_wins").between(low, high)).alias("accepted"),
    )


def _rounds(rewards: DataFrame) -> DataFrame:
    """(slot, round, group_id, members, flat) of collected rewards."""
    flat = F.min("reward") == F.max("reward")
    return rewards.groupBy("slot", "round", "group_id").agg(F.count(F.lit(1)).alias("members"), flat.alias("flat"))


def resampled(rewards: DataFrame, rounds: int, salt: str) -> DataFrame:
    """(slot, group_id, round, filled) the group each slot keeps, from recorded rounds (slot, round, group_id, reward).

    The first group that is not flat, whatever order groups were completed in; a slot without one gets one
    of its flat groups, drawn by hash.
    """
    groups = _rounds(rewards).where(F.col("round") < rounds)
    drawn = F.sha2(F.concat_ws("|", F.lit(salt), F.col("slot").cast("string"), F.col("group_id").cast("string")), 256)
    best = F.struct(F.col("flat").alias("filled"), F.when(~F.col("flat"), F.col("round")).alias("_r"), F.when(F.col("flat"), drawn).alias("_h"), "group_id", "round")
    return groups.groupBy("slot").agg(F.min(best).alias("b")).select("slot", "b.group_id", "b.round", "b.filled")


def collected(rewards: DataFrame, rounds: int = 16) -> DataFrame:
    """(slot, group_id, round, generated, rejected) of a strict collection: a slot without a group whose rewards differ within `rounds` is an error.

    A slot stops at its first such group; groups recorded after it are not counted.
    """
    groups = _rounds(rewards).where(F.col("round") < rounds)
    kept = F.min(F.when(~F.col("flat"), F.struct("round", "group_id")))
    slots = groups.groupBy("slot").agg(kept.alias("k"))
    ok = F.when(F.col("k").isNull(), F.raise_error(F.concat(F.lit("no effective group for slot "), F.col("slot").cast("string")))).otherwise(F.col("k.group_id"))
    return slots.select("slot", ok.alias("group_id"), "k.round", (F.col("k.round") + 1).alias("generated"), F.col("k.round").alias("rejected"))


def first_pass(rows: DataFrame) -> DataFrame:
    """What the curriculum is judged by: the rows of round 0 alone, as rejection would bias its win rates."""
    return rows.where(F.col("round") == 0)


def outcome_weight(wins: Column, n: Column) -> Column:
    """The weight a restart is drawn with: 1 without an outcome, 2 if mixed, 0.1 if all or none were won."""
    return F.when(wins.isNull(), F.lit(1.0)).when((wins > 0) & (wins < n), F.lit(2.0)).otherwise(F.lit(0.1))


def weighted_draws(rows: DataFrame, id_: str, weight: str, draws: DataFrame, seed: str, scale: int = 1000) -> DataFrame:
    """(draw, id) for each of `draws` (draw): rows drawn with replacement by weight, which counts in whole units of 1 / scale.

    In the order of ids each row is an interval of the whole numbers below the total; a draw is a number from a hash of
    the seed and the draw, 60 bits modulo the total. Both lie in one order, dealt to ranges, where a draw takes the last interval that starts at or before it: one sort and no pair that isn't a result.
    Rows without weight are never drawn; without any weight there are no draws.
    """
    units = F.round(F.col(weight) * scale).cast("long")
    kept = running(rows.select(F.col(id_).alias("id"), units.alias("_u")).where("_u > 0"), [], ["id", "_u"], "_u", "_at", "_total")
    digest = F.sha2(F.concat_ws("|", F.lit(seed), F.col("draw").cast("string")), 256)
    total = kept.agg(F.max("_total").alias("_total")).where("_total IS NOT NULL")
    points = draws.select("draw", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("_h")).crossJoin(F.broadcast(total))  # one row
    both = kept.select("_at", F.lit(0).alias("_kind"), F.struct("id").alias("_row"), F.lit(None).cast(draws.schema["draw"].dataType).alias("draw")).unionByName(
        points.select((F.col("_h") % F.col("_total")).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(f"struct<id: {kept.schema['id'].dataType.simpleString()}>").alias("_row"), "draw")
    )
    return filled(both, [], ["_at", "_kind", "draw"], "_row", "_hit").where("_kind = 1").select("draw", "_hit.id")


def rotating_queue(draws: DataFrame, pool: DataFrame, key: str, id_: str, seed: str) -> DataFrame:
    """(draw, id): the n-th draw of a key takes the n-th id of its pool, in an order that is shuffled anew (by hash) each time the pool is used up."""
    size = pool.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    turns = numbered(draws, [key], ["draw"], "_nth").join(size, key).withColumns({"_turn": F.expr("_nth div _size"), "_at": F.expr("_nth % _size")})
    wanted = turns.select(key, "_turn").distinct().join(pool.select(key, F.col(id_).alias("_id")), key)
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col("_turn").cast("string"), F.col("_id").cast("string")), 256)
    dealt = numbered(wanted.withColumn("_h", order), [key, "_turn"], ["_h", "_id"])
    return turns.join(dealt, [key, "_turn", "_at"]).select("draw", F.col("_id").alias(id_))
