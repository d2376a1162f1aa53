"""Places, running sums and neighbours in the order of a key that may hold most of a table's rows.

Rows are dealt to ranges of (key, order) by a sample of them, so a large key is many ranges; a range is numbered
by itself, and a table of one row a range and key gives what came before it. No task holds more than a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import shared_path


class Ranged:
    """Rows in ranges of (key, order), written to the shared folder once: ranges come from a sample, which another evaluation might draw otherwise.

    `rows` has two more columns: `_scan_range`, ascending along each key, and `_scan_id`, ascending along key and order. The order should be total.
    """

    def __init__(self, rows: DataFrame, key: list[str], order: list[str | Column], ranges: int | None = None):
        spark = rows.sparkSession
        by = [*map(F.col, key), *(F.col(c) if isinstance(c, str) else c for c in order)]
        n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_scan_id", F.monotonically_increasing_id())
        # the upper bits of such an id are the partition's number
        dealt = dealt.withColumn("_scan_range", F.shiftright("_scan_id", 33).cast("int"))
        path = shared_path(spark, "ranged")
        dealt.write.parquet(path)
        self.rows, self.key = spark.read.schema(dealt.schema).parquet(path), key

    def within(self):
        return Window.partitionBy("_scan_range", *self.key).orderBy("_scan_id")

    def ranges(self, **facts: Column) -> DataFrame:
        """One row a range and key: `_scan_range`, key, `_first` (its least _scan_id) and the aggregates asked for."""
        return self.rows.groupBy("_scan_range", *self.key).agg(F.min("_scan_id").alias("_first"), *(c.alias(n) for n, c in facts.items()))

    def before(self):
        """A window over the rows of ranges() that holds the earlier ranges of a key."""
        return Window.partitionBy(*self.key).orderBy("_scan_range").rowsBetween(Window.unboundedPreceding, -1)

    def joined(self, facts: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """rows with the facts of their range and key."""
        names = {k: f"_key{i}" for i, k in enumerate(("_scan_range", *self.key))}
        rows = self.rows if rows is None else rows
        same = reduce(lambda a, b: a & b, (rows[k].eqNullSafe(F.col(n)) for k, n in names.items()))
        return rows.join(facts.withColumnsRenamed(names), same).drop(*names.values())


def numbered(rows: DataFrame, key: list[str], order: list[str | Column], out: str = "_at", count: str | None = None, ranges: int | None = None) -> DataFrame:
    """rows with `out`, their place from 0 in the order of their key, and with `count`, the number of its rows. Nulls are a key like others."""
    ranged = Ranged(rows, key, order, ranges)
    facts = ranged.ranges(_n=F.count(F.lit(1)))
    facts = facts.withColumn("_before", F.coalesce(F.sum("_n").over(ranged.before()), F.lit(0)))
    if count:
        facts = facts.withColumn(count, F.sum("_n").over(Window.partitionBy(*key)))
    return ranged.joined(facts).withColumn(out, F.col("_scan_id") - F.col("_first") + F.col("_before")).drop("_scan_id", "_scan_range", "_first", "_n", "_before")


def runs(rows: DataFrame, key: list[str], order: list[str | Column], value: str, ranges: int | None = None) -> DataFrame:
    """rows with `run` (from 1: how often `value` has changed so far along the key), `_at` (place from 0 inside the run), `_n` (its rows) and `_last` (the key's last run)."""
    ranged = Ranged(rows, key, order, ranges)
    edges = ranged.ranges(_v=F.max_by(F.struct(F.col(value).alias("v")), "_scan_id"))
    edges = edges.withColumn("_before", F.lag("_v").over(Window.partitionBy(*key).orderBy("_scan_range")))
    own = F.struct(F.col(value).alias("v"))
    earlier = F.when(F.col("_scan_id") == F.col("_first"), F.col("_before")).otherwise(F.lag(own).over(ranged.within()))
    marked = ranged.joined(edges.drop("_v")).withColumn("_new", (~earlier.eqNullSafe(own)).cast("long")).drop("_before")
    # runs and starts so far: those of earlier ranges, and those of this one up to the row
    w = ranged.within().rowsBetween(Window.unboundedPreceding, 0)
    facts = marked.groupBy("_scan_range", *key).agg(F.count(F.lit(1)).alias("_rows"), F.sum("_new").alias("_runs"), F.max(F.when(F.col("_new") == 1, F.col("_scan_id") - F.col("_first"))).alias("_start"))
    before = ranged.before()
    facts = facts.withColumn("_done", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    facts = facts.withColumns({"_had": F.coalesce(F.sum("_runs").over(before), F.lit(0)), "_from": F.max(F.col("_start") + F.col("_done")).over(before), "_last": F.sum("_runs").over(Window.partitionBy(*key))})
    placed = ranged.joined(facts.drop("_rows", "_runs", "_start"), marked).withColumns({"_place": F.col("_done") + F.col("_scan_id") - F.col("_first"), "run": F.col("_had") + F.sum("_new").over(w)})
    start = F.coalesce(F.max(F.when(F.col("_new") == 1, F.col("_place"))).over(w), F.col("_from"))
    placed = placed.withColumn("_at", F.col("_place") - start).drop("_scan_id", "_scan_range", "_first", "_new", "_done", "_had", "_from", "_place")
    sizes = placed.groupBy(*key, "run").agg((F.max("_at") + 1).alias("_n")).withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(key)}).withColumnRenamed("run", "_run")
    same = reduce(lambda a, b: a & b, (placed[k].eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(key)), placed["run"] == F.col("_run"))
    return placed.join(sizes, same).drop("_run", *(f"_key{i}" for i in range(len(key))))


def filled(rows: DataFrame, key: list[str], order: list[str | Column], value: str, out: str, ranges: int | None = None) -> DataFrame:
    """rows with `out`: the last `value` that is not null at or before each row of its key; null before the first."""
    ranged = Ranged(rows, key, order, ranges)
    facts = ranged.ranges(_v=F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_scan_id"))))
    facts = facts.withColumn("_before", F.last("_v", ignorenulls=True).over(ranged.before())).drop("_v")
    inside = F.last(value, ignorenulls=True).over(ranged.within().rowsBetween(Window.unboundedPreceding, 0))
    return ranged.joined(facts).withColumn(out, F.coalesce(inside, "_before")).drop("_scan_id", "_scan_range", "_first", "_before")


def running(rows: DataFrame, key: list[str], order: list[str | Column], value: str, out: str, total: str | None = None, ranges: int | None = None) -> DataFrame:
    """rows with `out`: the sum of `value` over the rows before each of its key (0 at the first), and with `total` the key's sum."""
    ranged = Ranged(rows, key, order, ranges)
    facts = ranged.ranges(_s=F.sum(value))
    facts = facts.withColumn("_before", F.coalesce(F.sum("_s").over(ranged.before()), F.lit(0)))
    if total:
        facts = facts.withColumn(total, F.sum("_s").over(Window.partitionBy(*key)))
    inside = F.sum(value).over(ranged.within().rowsBetween(Window.unboundedPreceding, -1))
    return ranged.joined(facts.drop("_s")).withColumn(out, F.col("_before") + F.coalesce(inside, F.lit(0))).drop("_scan_id", "_scan_range", "_first", "_before")
