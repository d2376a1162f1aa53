"""Helpers shared by the training-data operators: staged tables, bounded broadcasts, prefix sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest staged table, in bytes on disk, that an operator will broadcast.
BROADCAST_BYTES = 24 << 20
#: Row bound that goes with BROADCAST_BYTES; both must hold.
BROADCAST_ROWS = 2_000_000
#: Spark's setting to remove a query's shuffle files when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session may fall back to a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="episodeframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str) -> None:
    """Write df as a Parquet table. Nothing reads the shuffle files of the write again, so they go as soon as it has ended, not when the driver collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage is cut and survives lost executors."""
    path = new_path(df.sparkSession, name)
    write(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that no later result reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(staged: DataFrame, limit_bytes: int = BROADCAST_BYTES, limit_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a staged table for broadcast if its files and rows are within the bounds; otherwise leave the join to Spark."""
    path = staged.sparkSession._jvm.org.apache.hadoop.fs.Path(staged.staged_path)
    size = path.getFileSystem(staged.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return F.broadcast(staged) if size <= limit_bytes and staged.count() <= limit_rows else staged


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bucket(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """Add `bucket`: consecutive ranges of a numeric column with about equal row counts. Null falls in bucket 0."""
    probs = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(df.stat.approxQuantile(column, probs, 0.25 / buckets))) if probs else []
    if not cuts:
        return df.withColumn("bucket", F.lit(0))
    # two levels of cuts: a row is compared with about 2 * sqrt(buckets) of them
    step = max(1, int(len(cuts) ** 0.5))
    parts = [[int(c) for c in cuts[i : i + step]] for i in range(0, len(cuts), step)]
    passed = lambda found: F.size(F.filter(found, lambda c: c < F.col(column)))
    coarse = passed(F.lit([p[0] for p in parts]))
    inner = F.element_at(F.lit(parts), coarse)
    bucket = F.when(coarse > 0, (coarse - 1) * step + passed(inner)).otherwise(F.lit(0))
    return df.withColumn("bucket", F.coalesce(bucket, F.lit(0)).cast("int"))


def running_start(df: DataFrame, order: list[str], value: str, out: str, ranges: int = 0) -> DataFrame:
    """Add `out`: the sum of `value` over all rows before, over a table with a `bucket` column of consecutive ranges.

    Each bucket is summed apart, a one-row-per-bucket table gives the offsets, and a
    window inside each bucket adds the rest: no task sees more than a bucket. With
    `ranges`, the buckets are dealt to so many partitions in their order.
    """
    sums = df.groupBy("bucket").agg(F.sum(value).alias("_s"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("bucket", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_b"))
    inside = Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = df.repartitionByRange(ranges, "bucket") if ranges else df
    return (
        dealt.join(F.broadcast(sums), "bucket")
        .withColumn(out, (F.col("_b") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long"))
        .drop("_b")
    )


def word_count(text) -> "F.Column":
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null counts 0. Adjacent separators are collapsed, so words = separators + 1."""
    t = F.coalesce(text, F.lit(""))
    blank = F.translate(t, "\t\n\x0b\x0c\r", "     ")
    flat = F.trim(F.regexp_replace(blank, "  +", " "))
    return F.when(flat == "", F.lit(0)).otherwise(F.length(flat) - F.length(F.translate(flat, " ", "")) + 1).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
