"""Operators over the order of steps: balances, streaks, rings, as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import numbered


def by_step(key: str = "episode_id", *order: str | Column):
    return Window.partitionBy(key).orderBy(*(order or ("step",)))


def gaps(steps: DataFrame) -> DataFrame:
    """Steps that do not follow the one before by one."""
    before = F.lag("step").over(by_step())
    return steps.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("step") != F.col("before") + 1))


def running_balance(steps: DataFrame) -> DataFrame:
    return steps.withColumn("balance", F.sum("delta").over(by_step().rowsBetween(Window.unboundedPreceding, 0)))


def longest_dry_streak(steps: DataFrame) -> DataFrame:
    """Longest run of steps without a gain in each episode: steps between gains share the number of gains so far."""
    island = F.count_if(F.col("delta") > 0).over(by_step().rowsBetween(Window.unboundedPreceding, 0))
    runs = steps.withColumn("island", island).groupBy("episode_id", "island").agg(F.count_if(F.col("delta") <= 0).alias("n"))
    return runs.groupBy("episode_id").agg(F.max("n").alias("longest"))


def oscillations(steps: DataFrame) -> DataFrame:
    """Steps back to the position of two steps before by the reverse of the last action."""
    w = by_step()
    reverse = F.translate(F.lag("action").over(w), "UDLR", "DURL")
    return steps.withColumn("returned", (F.lag("position", 2).over(w) == F.col("position")) & (reverse == F.col("action"))).groupBy("episode_id").agg(F.count_if("returned").alias("returns"))


def behaviour(steps: DataFrame) -> DataFrame:
    """Immediate reversals, A-B-A positions and changes of position per episode."""
    w = by_step()
    marked = steps.select(
        "episode_id",
        (F.translate(F.lag("action").over(w), "UDLR", "DURL") == F.col("action")).alias("reversal"),
        ((F.lag("position", 2).over(w) == F.col("position")) & (F.lag("position").over(w) != F.col("position"))).alias("aba"),
        (F.lag("position").over(w) != F.col("position")).alias("moved"),
    )
    return marked.groupBy("episode_id").agg(*(F.count_if(c).alias(f"{c}s") for c in ("reversal", "aba", "moved")))


def recent(steps: DataFrame, size: int = 8) -> DataFrame:
    return steps.select("episode_id", "step", F.concat_ws("", F.collect_list("action").over(by_step().rowsBetween(1 - size, 0))).alias("recent"))


def before_end(rows: DataFrame, key: str, order: list[str], distances: tuple[int, ...] = (4, 8, 16), died: Column | None = None) -> DataFrame:
    """Rows at the given distances before the last of their key; with `died`, only of keys whose last row it is true of."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    numbered = rows.withColumn("distance", (F.row_number().over(w) - 1).cast("long"))
    if died is None:
        return numbered.where(F.col("distance").isin(*distances))
    ended = numbered.withColumn("_died", F.first(died).over(w))
    return ended.where(F.col("_died") & F.col("distance").isin(*distances)).drop("_died")


def lookbacks(rows: DataFrame, key: str, order: list[str], death: Column, choices: tuple[int, ...] = tuple(range(4, 33))) -> DataFrame:
    """For every death, the places `back` before it that lie after the death before."""
    w = Window.partitionBy(key).orderBy(*order)
    numbered = rows.withColumn("at", F.row_number().over(w).cast("long")).where(death)
    last = F.coalesce(F.lag("at").over(Window.partitionBy(key).orderBy("at")), F.lit(0))
    return numbered.withColumn("last", last).withColumn("back", F.explode(F.array(*(F.lit(c).cast("long") for c in choices)))).where("at + 1 - back > last").select(key, "at", "back", (F.col("at") + 1 - F.col("back")).alias("start"))


def as_of(rows: DataFrame, key: str, order: list[str], marker: Column, out: str) -> DataFrame:
    """The latest marker at or before each row; null before the first."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(marker, ignorenulls=True).over(w))


def marker_consumers(rows: DataFrame, key: str, order: list[str], marker: Column) -> DataFrame:
    """The first row after each marker that is no marker itself: a marker serves one row."""
    found = as_of(rows, key, order, marker, "marker").where(~F.coalesce(marker.isNotNull(), F.lit(False)) & F.col("marker").isNotNull())
    first = F.row_number().over(Window.partitionBy(key, "marker").orderBy(*order))
    return found.withColumn("_n", first).where("_n = 1").drop("_n")


def evenly_spaced(rows: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """The rows at ((2i + 1) n) // (2k) for i < k of each key's n."""
    w = Window.partitionBy(key)
    numbered = rows.withColumns({"_at": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(((2 * i + 1) * F.col("_n")) / (2 * k)).cast("int"))
    return numbered.where(F.array_contains(wanted, F.col("_at"))).drop("_at", "_n")


def stride_and_tail(steps: DataFrame, stride: int, tail: int) -> DataFrame:
    left = F.row_number().over(by_step("episode_id", F.col("step").desc()))
    return steps.withColumn("_left", left).where((F.col("step") % stride == 0) | (F.col("_left") <= tail)).drop("_left")


def rotated(rows: DataFrame, key: str, order: str, update: int, take: int) -> DataFrame:
    """`take` rows of each key from place update * take on, around the end."""
    return numbered(rows, [key], [order], count="_of").withColumn("turn", F.expr(f"pmod(_at - {update * take}, _of)").cast("long")).where(F.col("turn") < take).drop("_at", "_of")


def chunked(rows: DataFrame, key: str, order: list[str], size: int, out: str) -> DataFrame:
    """rows with the number of their chunk of `size` rows in the order of their key."""
    return numbered(rows, [key], order).withColumn(out, F.expr(f"_at div {size}")).drop("_at")


def broken_options(steps: DataFrame, identity: list[str]) -> DataFrame:
    """Steps that break the continuity of options (option_step, ends): a first step follows an end, any other goes on with the same identity and the next number."""
    w = by_step()
    over = F.coalesce(F.lag("ends").over(w), F.lit(True))
    same = F.lag(F.struct(*identity)).over(w).eqNullSafe(F.struct(*identity))
    goes_on = ~over & same & (F.col("option_step") == F.lag("option_step").over(w) + 1)
    fine = F.when(F.col("option_step") == 1, over).otherwise(F.coalesce(goes_on, F.lit(False)))
    return steps.withColumn("_fine", fine).where("NOT _fine").drop("_fine")


def idle_counter(steps: DataFrame, watched: list[str]) -> DataFrame:
    """steps with `idle`: how many steps in a row none of the watched columns changed (0 where one did; before the first step they are 0)."""
    w = by_step()
    changed = F.greatest(*((F.col(c) != F.coalesce(F.lag(c).over(w), F.lit(0))).cast("int") for c in watched))
    if len(watched) == 1:
        changed = (F.col(watched[0]) != F.coalesce(F.lag(watched[0]).over(w), F.lit(0))).cast("int")
    islands = steps.withColumn("_gain", changed).withColumn("_island", F.sum("_gain").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy("episode_id", "_island").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return islands.withColumn("idle", F.count_if(F.col("_gain") == 0).over(inner)).drop("_gain", "_island")


def route_captures(rows: DataFrame, key: str, at: str, state: str, died: Column, distances: tuple[int, ...] = (4, 8, 16)) -> DataFrame:
    """(key, state, sources) of the states to start from: those a sixth and a third into a route (never the first), and at `distances` before the end
    of one that ended in death; places with one state are one candidate, its sources in order."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    counted = rows.withColumns({"_n": n, "_died": died})
    back = F.col("_n") - 1 - F.col(at)
    early = [F.when((F.col(at) > 0) & (F.col(at) == F.floor(F.col("_n") / part)), f"early_1/{part}") for part in (6, 3)]
    late = [F.when(F.col("_died") & (back == x), f"death_before_{x}") for x in distances]
    origins = F.filter(F.array(*early, *late), lambda o: o.isNotNull())
    marked = counted.withColumn("_o", origins).where(F.size("_o") > 0)
    source = F.struct(F.col(at).alias("i"), back.alias("distance"), F.col("_o").alias("origins"))
    return marked.groupBy(key, state).agg(F.array_sort(F.collect_list(source)).alias("sources"))


def switches(steps: DataFrame, objective: list[str]) -> DataFrame:
    """(episode_id, calls, switches): how often the objective differs from that of the call before."""
    w = by_step()
    differs = ~F.lag(F.struct(*objective)).over(w).eqNullSafe(F.struct(*objective)) & F.lag("step").over(w).isNotNull()
    return steps.withColumn("_s", differs).groupBy("episode_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if("_s").alias("switches"))


def zipped(a: DataFrame, b: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of two ordered streams in turn, with their `place`; what one stream has beyond the other's end is left out."""
    sides = [numbered(df, [key], order).withColumn("_side", F.lit(i)) for i, df in enumerate((a, b))]
    both = [x.join(y.select(key, "_at"), [key, "_at"], "left_semi") for x, y in (sides, sides[::-1])]
    return both[0].unionByName(both[1]).withColumn("place", 2 * F.col("_at") + F.col("_side")).drop("_at", "_side")


def every_third(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with `split`: the third, sixth, ... of each key are for validation."""
    return numbered(rows, [key], order).withColumn("split", F.when(F.col("_at") % 3 == 2, "validation").otherwise("train")).drop("_at")


def batches_of_updates(files: DataFrame, updates: DataFrame, key: str, files_by: list[str], updates_by: list[str], size: int, *facts: Column) -> DataFrame:
    """(key, batch, n, facts..., the update's columns): the i-th full batch of `size` files of a key belongs to its i-th update, by place alone."""
    per = chunked(files, key, files_by, size, "batch").groupBy(key, "batch").agg(F.count(F.lit(1)).alias("n"), *facts)
    return per.where(F.col("n") == size).join(numbered(updates, [key], updates_by, "batch"), [key, "batch"])
