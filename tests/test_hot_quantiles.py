"""Quantiles of few keys of many rows."""

from pyspark.sql import functions as F

from episodeframe.operators import orderstats


def test_rows_of_a_hot_key_stay_where_they_are(spark):
    n = 2_000_000  # more than Spark would broadcast
    rows = spark.range(n).select((F.col("id") % 2).alias("k"), F.expr("id div 2 * 7919 % 1000003").cast("double").alias("v"))
    found = orderstats.nearest_ranks(rows, ["k"], "v", {"p50": 0.5, "p99": 0.99})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    half = sorted(i * 7919 % 1000003 for i in range(n // 2))
    want = tuple(float(half[round((n // 2 - 1) * f)]) for f in (0.5, 0.99))
    assert {r.k: (r.p50, r.p99) for r in found.collect()} == {0: want, 1: want}
