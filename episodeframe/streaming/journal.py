"""An append-only journal of metrics, read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.growing import complete_lines

SCHEMA = "source_step long, metrics map<string,double>, time double"


def read_journal(spark: SparkSession, path: str, stream: bool = True, end: str = "END") -> DataFrame:
    """(source_step, key, value, time) of the finite, namespaced metrics of a folder of JSON lines that grow; lines that are no event are passed over."""
    lines = complete_lines(spark, path, stream, end).where("NOT closed")
    rows = lines.select(F.from_json("line", SCHEMA).alias("r")).select("r.*").where(F.col("source_step").isNotNull())
    flat = rows.select("source_step", F.explode("metrics").alias("key", "value"), "time")
    return flat.where(F.col("key").contains("/") & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and value sums by time window and type; `ts` without a zone is read as UTC."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
