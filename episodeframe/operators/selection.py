"""Top-k, quotas, sets and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .orderstats import middle_row
from .scans import numbered


def first_of(rows: DataFrame, key: list[str], *order: Column, k: int = 1) -> DataFrame:
    """The first k rows of each key."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("place", n).where(F.col("place") <= k).withColumn("place", F.col("place").cast("long"))


def best(rows: DataFrame, *order: Column) -> DataFrame:
    """The one row that comes first. A top-1 that is merged from each partition's own."""
    return rows.orderBy(*order).limit(1)


def natural_key(label: Column) -> Column:
    """A label whose digit runs sort as numbers: update2 before update12, whatever their length."""
    parts = F.regexp_extract_all(label, F.lit("(\\d+|\\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^\\d+$"), _counted(p)).otherwise(p)), "")


def _counted(digits: Column) -> Column:
    """A run of digits behind its own length, so that runs of any length sort as numbers."""
    plain = F.regexp_replace(digits, "^0+(?=\\d)", "")
    return F.concat(F.lpad(F.length(plain).cast("string"), 10, "0"), plain)


def typical_best_worst(rows: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """(key, role, tie, value): the row at place n // 2 of each key's rows by (value, tie), the last and the first; nulls in value are passed over."""
    kept = rows.where(F.col(value).isNotNull()).select(key, value, tie)
    middle = middle_row(kept, [key], value, F.col(tie)).select(key, F.lit("typical").alias("role"), tie, value)
    ends = kept.groupBy(key).agg(F.max(F.struct(value, tie)).alias("best"), F.min(F.struct(value, tie)).alias("worst"))
    ends = ends.select(key, F.explode(F.create_map(F.lit("best"), "best", F.lit("worst"), "worst")).alias("role", "r")).select(key, "role", f"r.{tie}", f"r.{value}")
    every = middle.unionByName(ends).groupBy(key, tie, value).agg(F.collect_set("role").alias("_roles"))
    # one row may play several parts in a small key
    return every.select(key, F.concat(*(F.when(F.array_contains("_roles", r), r).otherwise("") for r in ("typical", "best", "worst"))).alias("role"), tie, value)


def round_robin(rows: DataFrame, tier: str, bin_: str, order: list[Column], cap: int) -> DataFrame:
    """Up to cap rows of a tier, one of each bin in turn."""
    # row numbers are bounded as they are, so that each task keeps cap rows of a key before anything is shuffled
    inner = F.row_number().over(Window.partitionBy(tier, bin_).orderBy(*order))
    outer = F.row_number().over(Window.partitionBy(tier).orderBy("round", bin_))
    kept = rows.withColumn("round", inner).where(F.col("round") <= cap).withColumn("place", outer).where(F.col("place") <= cap)
    return kept.withColumns({c: F.col(c).cast("long") for c in ("round", "place")})


def diverse_top(rows: DataFrame, group: str, kind: list[str], order: list[Column], k: int) -> DataFrame:
    """One of each kind in order of cost, then the rest in order of cost, k in all."""
    first = F.row_number().over(Window.partitionBy(group, *kind).orderBy(*order)) == 1
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col("_first").desc(), *order))
    return rows.withColumn("_first", first).withColumn("place", place.cast("long")).where(F.col("place") <= k).drop("_first")


def hash_subset(rows: DataFrame, group: str, id_: str, salt: str, k: int) -> DataFrame:
    """k rows of each group by the SHA-256 of salt, group and id joined by bars."""
    digest = F.sha2(F.concat_ws("|", F.lit(salt), F.col(group).cast("string"), F.col(id_).cast("string")), 256)
    return first_of(rows.withColumn("digest", digest), [group], F.col("digest"), F.col(id_), k=k)


def shards(rows: DataFrame, group: str, order: list[str], world: int, eligible: Column) -> DataFrame:
    """Rank of every eligible row; the place is counted before the ineligible ones go."""
    return numbered(rows, [group], order).withColumn("rank", F.col("_at") % world).where(eligible).drop("_at")


def leaking(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that stand in more than one split."""
    return rows.groupBy(key).agg(F.count_distinct(split).alias("splits"), F.count(F.lit(1)).alias("n")).where("splits > 1")


def repeated_ids(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def latest_union(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Union by name; of one key the row of `new` stays."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col("_new").desc()))).where("_n = 1").drop("_n", "_new")


def reserved(rows: DataFrame, key: str, held: DataFrame) -> DataFrame:
    """Rows whose key is not held out."""
    return rows.join(held.select(key).distinct(), key, "left_anti")


def uncovered(rows: DataFrame, group: str, index: str, size: int) -> DataFrame:
    """Groups whose indices are not exactly 0..size-1."""
    want = F.sequence(F.lit(0), F.lit(size - 1))
    return rows.groupBy(group).agg(F.array_sort(F.collect_list(F.col(index).cast("int"))).alias("have")).where(F.col("have") != want).select(group, F.size("have").cast("long").alias("have"))


def missing_sides(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, and which."""
    left, right = a.select(key).distinct().withColumn("_a", F.lit(True)), b.select(key).distinct().withColumn("_b", F.lit(True))
    return left.join(right, key, "full").where("_a IS NULL OR _b IS NULL").select(key, F.when(F.col("_a").isNull(), "right").otherwise("left").alias("side"))


def matching(rows: DataFrame, **values) -> DataFrame:
    """rows whose columns have the given values."""
    for name, value in values.items():
        rows = rows.where(F.col(name) == value)
    return rows


def strict_join(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """rows joined to `known`; a key that is not known is an error."""
    both = rows.join(known.withColumn("_known", F.lit(True)), key, "left")
    checked = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("unknown id "), F.col(key).cast("string")))).otherwise(F.col(key))
    return both.withColumn(key, checked).drop("_known")


def known_ids(ids: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """One row: the number of ids, whether they are distinct, and whether all are known."""
    marked = ids.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).join(known.select(key).distinct().withColumn("_k", F.lit(True)), key, "left")
    return marked.agg(F.count(F.lit(1)).alias("ids"), F.coalesce(F.max("_n") == 1, F.lit(True)).alias("distinct_ids"), (F.count_if(F.col("_k").isNull()) == 0).alias("known"))


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many keys only a has, and only b; two zeros mean equal sets."""
    sides = missing_sides(a, b, key)
    return sides.agg(F.count_if(F.col("side") == "left").alias("only_left"), F.count_if(F.col("side") == "right").alias("only_right"))


def placed(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """rows with their `place` in the order of their key."""
    return numbered(rows, [key], list(order), "place").withColumn("place", F.col("place") + 1)


def risk_ranked(rows: DataFrame, key: str, *tie: Column) -> DataFrame:
    """rows (motion, margin, clearance, exits, dead_end, reverse) with `rank`: certain motion first, then the wider margin and clearance (none counts as
    the widest), more exits, no dead end, no reversal; ties keep their order."""
    motion = F.when(F.col("motion") == "clear_estimate", 0).when(F.col("motion") == "unknown", 1).otherwise(2)
    order = [motion, F.col("margin").desc(), F.coalesce("clearance", F.lit(10**6)).desc(), F.col("exits").desc(), F.col("dead_end"), F.col("reverse"), *tie]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def first_strategy(rows: DataFrame, key: str, strategy: str, ranks: tuple[str, ...], order: str) -> DataFrame:
    """(key, order) of each key's first row of the best strategy that it has; strategies that are not ranked come last."""
    at = F.array_position(F.array(*map(F.lit, ranks)), F.col(strategy))
    rank = F.when(at > 0, at).otherwise(len(ranks) + 1)
    return rows.groupBy(key).agg(F.min_by(order, F.struct(rank.alias("r"), F.col(order).alias("o"))).alias(order))


def reserved_in_turn(rows: DataFrame, key: str, role: str, roles: tuple[str, ...]) -> DataFrame:
    """rows whose key no earlier role has: the roles reserve their keys in turn."""
    rank = F.array_position(F.array(*map(F.lit, roles)), F.col(role))
    first = rows.groupBy(key).agg(F.min(rank).alias("_first"))
    return rows.join(first, key).where(rank == F.col("_first")).drop("_first")


def incomplete_batches(rows: DataFrame, batch: str, group: str, replica: str, groups: int, size: int) -> DataFrame:
    """(batch, groups, members, repeated, outside) of the batches that don't hold each of `size` replicas of `groups` groups exactly once."""
    per = rows.groupBy(batch, group).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(replica).alias("_d"), F.count_if(~F.col(replica).between(0, size - 1)).alias("_o"))
    found = per.groupBy(batch).agg(F.count(F.lit(1)).alias("groups"), F.sum("_n").alias("members"), (F.sum("_n") - F.sum("_d")).alias("repeated"), F.sum("_o").alias("outside"))
    return found.where((F.col("groups") != groups) | (F.col("members") != groups * size) | (F.col("repeated") > 0) | (F.col("outside") > 0))


def ranked_by_strategy(rows: DataFrame, key: str, strategy: str, limits: dict[str, int], *order: Column) -> DataFrame:
    """The first rows of each key and strategy, as many as the strategy's limit; strategies without a limit are left out."""
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col(strategy)]
    place = F.row_number().over(Window.partitionBy(key, strategy).orderBy(*order)).cast("long")
    return rows.where(F.col(strategy).isin(*limits)).withColumn("place", place).where(F.col("place") <= limit)
