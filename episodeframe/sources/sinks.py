"""Writers that never replace what is there."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats counted."""
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def write_once(df: DataFrame, path: str) -> bool:
    """Write df if nothing is there; the same rows again are accepted, other rows are an error. True if it wrote."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        if not same_rows(df, spark.read.schema(df.schema).parquet(path)):
            raise ValueError(f"{path} holds other rows")
        return False
    df.write.mode("errorifexists").parquet(path)
    return True


def row_digest(df: DataFrame) -> DataFrame:
    """One row (rows, digest) that does not depend on the order of rows: SHA-256 of the sum of 60 bits of each row's SHA-256.

    A value is marked by `v` and a null is `n`, so (null, 1) and (1, null) differ, and repeats count.
    """
    row = F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in df.columns))
    part = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.coalesce(F.sum(part), F.lit(0)).cast("string"), 256).alias("digest"))


def manifest(df: DataFrame, name: str, key: str) -> DataFrame:
    """One row: name, row count, distinct keys, and the digest of row_digest()."""
    facts = row_digest(df).select(F.lit(name).alias("name"), "rows", "digest")
    return facts.crossJoin(df.agg(F.count_distinct(key).alias("keys"))).select("name", "rows", "keys", "digest")  # one row each


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share; only a local session may do without one named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="episodeframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_episodes(df: DataFrame, path: str, rules: list, *key: str) -> None:
    """One folder of JSON an episode, named by its key with unsafe characters replaced. Nothing is written if a row breaks a rule, two keys get one name, or the path exists."""
    from ..functions.scalar import safe_name
    from ..operators.audit import violations

    if not violations(df, rules, *key).isEmpty():
        raise ValueError("a row breaks a rule")
    named = df.withColumn("_name", safe_name(F.concat_ws("--", *(F.col(k).cast("string") for k in key))))
    if not named.groupBy("_name").count().where("count > 1").isEmpty():
        raise ValueError("two episodes have one name")
    named.repartition("_name").write.mode("errorifexists").partitionBy("_name").json(path)


def write_canonical(df: DataFrame, path: str, *order: str) -> DataFrame:
    """JSON lines with sorted keys, in order over the numbered parts of a folder that must not exist; one row (rows, digest) comes back.

    The digest is row_digest() of the lines read back: their order follows from the rows, and how they are cut
    into parts must not matter.
    """
    spark = df.sparkSession
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_{i}" for i in range(len(order))]
    ranged = df.select(*(F.col(c).alias(k) for c, k in zip(order, keys, strict=True)), line.alias("value")).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    ranged.select("value").write.mode("errorifexists").text(path)
    return row_digest(spark.read.text(path))


def append_attempts(df: DataFrame, path: str) -> None:
    """Adds rows to a folder of JSON lines; what is there stays."""
    df.write.mode("append").json(path)


def reports(steps: DataFrame, key: str, order: str, columns: list[str], title: str) -> DataFrame:
    """(key, text): a Markdown table of each key's rows in order, under a title."""
    bars = lambda values: F.concat(F.lit("| "), F.concat_ws(" | ", *values), F.lit(" |"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), bars([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("line")))), lambda x: x["line"])
    head = F.concat(F.lit(f"# {title} "), F.col(key).cast("string"), F.lit("\n\n| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"))
    return steps.groupBy(key).agg(lines.alias("_l")).select(key, F.concat(head, F.array_join("_l", "\n")).alias("text"))


def publish(df: DataFrame, path: str, update: int, state: dict[str, str]) -> None:
    """A joint checkpoint: data, then a receipt with its rows, digest and the controller's state, and the pointer last. A completed update is never replaced."""
    spark = df.sparkSession
    done = f"{path}/receipts/{update:07d}"
    if _exists(spark, done):
        raise ValueError(f"update {update} is completed")
    df.write.mode("overwrite").parquet(f"{path}/data/{update:07d}")  # what an unfinished attempt left
    facts = row_digest(spark.read.schema(df.schema).parquet(f"{path}/data/{update:07d}")).first()
    receipt = spark.createDataFrame([(update, facts.rows, facts.digest, state)], "update long, rows long, digest string, state map<string,string>")
    receipt.coalesce(1).write.mode("errorifexists").json(done)
    spark.createDataFrame([(update, facts.digest)], "update long, digest string").coalesce(1).write.mode("append").json(f"{path}/pointer")


def restore(spark: SparkSession, path: str, schema, update: int | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Data and state of an update, the last one by default, after its receipt and digest have been checked."""
    if update is None:
        update = spark.read.schema("update long, digest string").json(f"{path}/pointer").agg(F.max("update")).first()[0]
    told = spark.read.schema("update long, rows long, digest string, state map<string,string>").json(f"{path}/receipts/{update:07d}").first()
    df = spark.read.schema(schema).parquet(f"{path}/data/{update:07d}")
    facts = row_digest(df).first()
    if (facts.rows, facts.digest, told.update) != (told.rows, told.digest, update):
        raise ValueError(f"update {update} does not fit its receipt")
    return df, told.state


class Ledger:
    """A sink of a stream's batches (for foreachBatch) that a replay adds nothing to: a batch's rows, in a folder of its own, then its ledger entry.

    A batch whose entry is there is passed over. One without an entry is unfinished, whatever lies in its folder: it is written anew, and
    committed() never shows it. Entries are created, never replaced, so of two writers of one batch the later fails.
    """

    def __init__(self, path: str, before_entry=None):
        self.path, self.before_entry = path.rstrip("/"), before_entry

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        entry = f"{self.path}/ledger/{batch_id:012d}.json"
        if _exists(spark, entry):
            return
        batch.write.mode("overwrite").parquet(f"{self.path}/data/batch={batch_id}")
        if self.before_entry:
            self.before_entry(batch_id)
        target = spark._jvm.org.apache.hadoop.fs.Path(entry)
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
        out.write(bytearray(json.dumps({"batch": batch_id}).encode()))
        out.close()

    def batches(self, spark: SparkSession) -> DataFrame:
        """(batch) of the ledger's entries."""
        if not _exists(spark, f"{self.path}/ledger"):
            return spark.createDataFrame([], "batch long")
        return spark.read.schema("batch long").json(f"{self.path}/ledger")

    def committed(self, spark: SparkSession, schema) -> DataFrame:
        """The rows of finished batches, with their `batch`."""
        kind = StructType(spark.createDataFrame([], schema).schema.fields).add("batch", "long")
        if not _exists(spark, f"{self.path}/data"):
            return spark.createDataFrame([], kind)
        return spark.read.schema(kind).option("basePath", f"{self.path}/data").parquet(f"{self.path}/data").join(self.batches(spark), "batch", "left_semi")
