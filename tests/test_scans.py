"""Ordered scans over ranges against windows over whole keys."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from episodeframe.operators import banks, evaluation, ordered, scans, selection


def table(spark, n, keys, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(keys), rng.random(), i, rng.choice("ab") if rng.random() < 0.2 else "a") for i in range(n)]
    return spark.createDataFrame(rows, "k string, x double, id long, v string").repartition(5)


def plain(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("keys", [["one"], ["a", "b", None, "c"], [str(i) for i in range(300)]])
@pytest.mark.parametrize("ranges", [1, 7])
def test_numbered(spark, keys, ranges):
    rows = table(spark, 900, keys)
    w = Window.partitionBy("k")
    want = rows.withColumns({"_at": (F.row_number().over(w.orderBy(F.col("x").desc(), "id")) - 1).cast("long"), "n": F.count(F.lit(1)).over(w)})
    got = scans.numbered(rows, ["k"], [F.col("x").desc(), "id"], count="n", ranges=ranges)
    assert got.columns == [*rows.columns, "n", "_at"]
    assert plain(got, "k", "id", "_at", "n") == plain(want, "k", "id", "_at", "n")


@pytest.mark.parametrize("keys", [["one"], ["a", None, "c"], [str(i) for i in range(200)]])
def test_runs(spark, keys):
    rows = table(spark, 700, keys)
    w = Window.partitionBy("k").orderBy("x", "id")
    changed = rows.withColumn("c", (~F.lag(F.struct("v")).over(w).eqNullSafe(F.struct("v"))).cast("int")).withColumn("run", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy("k", "run")
    want = changed.withColumns({"_at": (F.row_number().over(inner.orderBy("x", "id")) - 1).cast("long"), "_n": F.count(F.lit(1)).over(inner), "_last": F.max("run").over(Window.partitionBy("k"))})
    for ranges in (1, 9, 40):
        got = scans.runs(rows, ["k"], ["x", "id"], "v", ranges)
        assert plain(got, "id", "run", "_at", "_n", "_last") == plain(want, "id", "run", "_at", "_n", "_last")


def test_one_key_is_many_ranges(spark):
    """A key that holds the whole table: no task gets more than about its share, and places, chunks and turns run on over the ranges."""
    rows = spark.range(40_000).select(F.lit("k").alias("k"), ((F.col("id") * 7919) % 40_009).alias("x"), "id")
    sizes = [r.n for r in scans.Ranged(rows, ["k"], ["x"], 16).rows.groupBy("_scan_range").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 40_000 / 16
    got = ordered.chunked(rows, "k", ["x"], 16, "batch").groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("batch").collect()
    assert len(got) == 2500 and {r.n for r in got} == {16} and all(a.high < b.low for a, b in zip(got, got[1:]))
    assert ordered.rotated(rows, "k", "x", 3, 5).orderBy("turn").select("turn").collect() == [(i,) for i in range(5)]
    assert ordered.every_third(rows, "k", ["x"]).groupBy("split").count().collect() in ([("train", 26667), ("validation", 13333)], [("validation", 13333), ("train", 26667)])


def test_bounded_ranks_are_kept_before_the_shuffle(spark):
    """Ranks with a bound keep a key's first rows in each task already."""
    rows = spark.range(5000).select((F.col("id") % 2).alias("tier"), (F.col("id") % 3).alias("bin"), "id")
    for df, limits in ((selection.round_robin(rows, "tier", "bin", [F.col("id").desc()], 10), 4), (selection.first_of(rows, ["tier"], F.col("id"), k=4), 2)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") >= limits


def test_evictions_of_a_full_bucket(spark):
    bank = spark.range(3000).select(F.col("id").alias("state_id"), F.lit("b").alias("bucket"), F.lit(1).alias("seed"), (F.col("id") % 5).alias("usage"), (F.col("id") % 11).alias("last_probe"))
    order = [F.col("usage").desc(), F.col("last_probe"), F.col("state_id")]
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    want = {r.state_id for r in bank.withColumn("p", place).where("p <= 2996").collect()}
    got = banks.evicted(bank, per_seed=3).collect()
    assert {r.state_id for r in got if r.reason == "bucket"} == want
    left = bank.withColumn("p", place).where("p > 2996").orderBy("p").first().state_id
    assert [r.state_id for r in got if r.reason == "seed"] == [left]


def test_empty_tables(spark):
    rows = table(spark, 5, ["a"]).where("false")
    assert scans.numbered(rows, ["k"], ["x"]).collect() == [] == scans.runs(rows, ["k"], ["x"], "v").collect()
    assert evaluation.in_batches(rows, "k", ["x"], "v", {"a": 2, "b": 3}).collect() == []


@pytest.mark.parametrize("keys", [["one"], ["a", None, "c"], [str(i) for i in range(200)]])
def test_filled_and_running(spark, keys):
    rows = table(spark, 600, keys).withColumn("m", F.when(F.col("id") % 17 == 0, F.col("id")))
    w = Window.partitionBy("k").orderBy("x", "id")
    want = rows.withColumns({"last": F.last("m", ignorenulls=True).over(w), "sum": F.coalesce(F.sum("id").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all": F.sum("id").over(Window.partitionBy("k"))})
    for ranges in (1, 8):
        assert plain(scans.filled(rows, ["k"], ["x", "id"], "m", "last", ranges), "id", "last") == plain(want, "id", "last")
        assert plain(scans.running(rows, ["k"], ["x", "id"], "id", "sum", "all", ranges), "id", "sum", "all") == plain(want, "id", "sum", "all")


def test_draws_by_weight(spark):
    """Draws are the rows that plain cumulative weights give for the same points."""
    import hashlib
    from bisect import bisect_right
    from itertools import accumulate

    rng = random.Random(3)
    weights = [rng.choice([0.0, 0.1, 1.0, 2.0, 500.0]) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(weights)), "i long, w double").repartition(7)
    kept = [(i, round(w * 1000)) for i, w in enumerate(weights) if w]
    ends = list(accumulate(u for _, u in kept))
    point = lambda k: int(hashlib.sha256(f"s|{k}".encode()).hexdigest()[:15], 16) % ends[-1]
    got = {r.draw: r.id for r in banks.weighted_draws(rows, "i", "w", spark.range(500).withColumnRenamed("id", "draw"), "s").collect()}
    assert got == {k: kept[bisect_right(ends, point(k))][0] for k in range(500)}
    assert banks.weighted_draws(rows.where("w = 0"), "i", "w", spark.range(5).withColumnRenamed("id", "draw"), "s").collect() == []


def test_batches_belong_to_updates_by_place(spark):
    files = spark.range(50).select(F.lit("r").alias("run"), F.col("id").alias("at"))
    updates = spark.createDataFrame([("r", 30), ("r", 10), ("r", 20), ("other", 1)], "run string, update int")
    got = ordered.batches_of_updates(files, updates, "run", ["at"], ["update"], 16, F.min("at").alias("low"))
    assert sorted((r.update, r.n, r.low) for r in got.collect()) == [(10, 16, 0), (20, 16, 16), (30, 16, 32)]
