"""Exact order statistics by key in bounded memory: no key's values are ever held in one buffer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import shared_path

#: Relative accuracy of the sketch that brackets a rank; keys of up to so many rows are not bracketed.
ACCURACY = 10_000


def located(rows: DataFrame, key: list[str], value: str, ranks: dict[str, tuple[float, Column]]) -> DataFrame:
    """(key, _stat, n, rank, low, below, high): of each key's n values that are not null, the one at `rank` (from 0) in
    ascending order, how many are less, and the next one.

    `ranks` gives, by name (`_stat`), about where in [0, 1] a rank lies and the exact rank as a column over `n`. A quantile
    sketch of bounded size brackets each rank; a second pass counts what lies below the bracket and
    sums up the values inside it, about 8 / ACCURACY of the rows, so ties of any number cost one row. The first pass runs
    at once, its brackets are kept in the shared folder.
    """
    kept = rows.where(F.col(value).isNotNull()).select(*key, F.col(value).alias("_v"))
    names = list(ranks)
    points = [max(0.0, ranks[n][0] - 4 / ACCURACY) for n in names] + [min(1.0, ranks[n][0] + 4 / ACCURACY) for n in names]
    stats = kept.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", points, ACCURACY).alias("_b"))
    few = F.col("n") <= ACCURACY
    each = F.array(*(F.struct(F.lit(name).alias("_stat"), ranks[name][1].cast("long").alias("rank"), F.when(~few, F.col("_b")[i]).alias("from"), F.when(~few, F.col("_b")[i + len(names)]).alias("to")) for i, name in enumerate(names)))
    brackets = stats.select(*key, "n", F.explode(each).alias("r")).select(*key, "n", "r.*")
    if key:
        # read back, so that Spark knows their size: brackets of few keys are broadcast, and no key's rows are dealt to one task for the join
        path = shared_path(rows.sparkSession, "brackets")
        brackets.write.parquet(path)
        brackets = rows.sparkSession.read.schema(brackets.schema).parquet(path)
        marked = kept.join(brackets, key)
    else:
        marked = kept.crossJoin(F.broadcast(brackets))  # one row a name
    inside = F.coalesce(F.col("_v") >= F.col("from"), F.lit(True))
    marked = marked.where(F.coalesce(F.col("_v") <= F.col("to"), F.lit(True)))
    counts = marked.groupBy(*key, "_stat", "n", "rank", F.when(inside, F.col("_v")).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*key, "_stat").orderBy(F.col("_x").asc_nulls_first())
    placed = counts.withColumns({"_end": F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.lead("_x").over(w)})
    hit = placed.where((F.col("_end") - F.col("_c") <= F.col("rank")) & (F.col("rank") < F.col("_end")))
    high = F.when(F.col("rank") + 1 < F.col("_end"), F.col("_x")).otherwise(F.coalesce("_next", "_x"))
    return hit.select(*key, "_stat", "n", "rank", F.col("_x").alias("low"), (F.col("_end") - F.col("_c")).alias("below"), high.alias("high"))


def _wide(found: DataFrame, key: list[str], names: list[str], value: Column) -> DataFrame:
    return found.groupBy(*key).agg(*(F.max(F.when(F.col("_stat") == n, value)).alias(n) for n in names))


def linear_quantiles(rows: DataFrame, key: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """A column for each point, interpolated between the neighbours of place (n - 1) f; keys without values are left out."""
    found = located(rows, key, value, {n: (f, F.floor((F.col("n") - 1) * F.lit(f))) for n, f in points.items()})
    at = F.coalesce(*(F.when(F.col("_stat") == n, F.lit(f)) for n, f in points.items()))
    part = (F.col("n") - 1) * at - F.col("rank")
    return _wide(found, key, list(points), F.col("low") + part * (F.col("high") - F.col("low")))


def nearest_ranks(rows: DataFrame, key: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """A column for each point: the value at place (n - 1) f, rounded half to even."""
    found = located(rows, key, value, {n: (f, F.bround((F.col("n") - 1) * F.lit(f))) for n, f in points.items()})
    return _wide(found, key, list(points), F.col("low"))


def middle_row(rows: DataFrame, key: list[str], value: str, *tie: Column) -> DataFrame:
    """The row at place n // 2 of each key's rows in order of a value that is not null, then `tie`: only rows with that one value are ordered."""
    found = located(rows, key, value, {"middle": (0.5, F.expr("n div 2"))}).select(*key, F.col("low").alias("_low"), (F.col("rank") - F.col("below")).alias("_place"))
    same = rows.join(found, key).where(F.col(value) == F.col("_low"))
    at = F.row_number().over(Window.partitionBy(*key).orderBy(*tie)) - 1
    return same.withColumn("_at", at).where("_at = _place").drop("_at", "_place", "_low")
