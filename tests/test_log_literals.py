"""Metrics of dict literals: the map is made once a row, and the later of equal keys still wins."""

from pyspark.sql import functions as F

from episodeframe.functions import records
from episodeframe.plans import registry


def test_the_text_is_searched_once_for_keys_and_once_for_values(spark):
    plan = registry.QUERIES["fn11_ag23_log_literals"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2  # the filter that Spark infers for an explode, and the lambda, had more


def test_last_of_equal_keys_and_rows_without_metrics(spark):
    texts = ["{'a/b': 1, 'a/c': 2, 'a/b': 3}", "{'a/b': 1, 'a/b': nan}", "{'plain': 1}", "{}", "no dict", None, "{'a/b': 1, 'a/b': 2, 'a/b': 4, 'c/d': -5e1,}"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", records.literal_metrics(F.col("t")).alias("m")).orderBy("i").collect()
    assert [r.m for r in rows] == [{"a/b": 3.0, "a/c": 2.0}, {"a/b": 1.0}, {}, {}, None, None, {"a/b": 4.0, "c/d": -50.0}]
