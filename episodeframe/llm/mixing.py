"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, partitions, small, stage, word_count

SEED = 17


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_rows, source_size, target) from one row per document (source, size).

    Sources by code point, null last, weigh `weights` in turn. They share the total; a target stops
    at cap times its source's size and the excess is reshared by weight. The fixed point of that
    resharing is target = min(cap * size, level * weight): ordered by cap * size / weight, the
    capped sources are a prefix, so one running sum finds the level. One row per source is held,
    never one per document.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("source_rows"), F.sum("size").cast("long").alias("source_size"))
    byname = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.lit([float(w) for w in weights])
    per = per.withColumn("_w", F.element_at(cycle, ((F.row_number().over(byname) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("_ratio", cap * F.col("source_size") / F.col("_w"))
    # the sources before this one, in order of how soon they are capped
    before = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = per.withColumns({"_total": F.sum("source_size").over(whole), "_wsum": F.sum("_w").over(whole)})
    per = per.withColumns({"_capb": F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0.0)), "_wb": F.coalesce(F.sum("_w").over(before), F.lit(0.0))})
    per = per.withColumn("_level", (F.col("_total") - F.col("_capb")) / (F.col("_wsum") - F.col("_wb")))
    # the first source whose own cap is not below the level reached there, fixes the level of all after it
    per = per.withColumn("_fix", F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_wb", "_level"))).over(whole)["_level"])
    return per.select("source", "source_rows", "source_size", F.least(cap * F.col("source_size"), F.col("_fix") * F.col("_w")).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: `doc_id, source, size, source_size, target, copies, taken`.

    Every document gets a hash-random key; each source is range-sorted by it (ranges of the key,
    as many as the source has rows for), prefix sums of sizes run inside each range and over the
    range totals, and the mix is cut at the source's budget floor(target). Whole epochs first:
    `copies` is how often the whole document is taken; the document in which the budget ends
    is taken for the words that are left, so `taken` sums to the budget exactly.

    Null text counts 0 words and is never cut short. Ties in the key (repeated rows) are ordered
    by id and size, so a rerun takes the same words. An empty table gives no rows.
    """
    spark = docs.sparkSession
    sized = stage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    targets = stage(source_targets(sized, weights, cap), "mix-targets")
    total = sized.count()
    per_range = max(1, total // (4 * partitions(spark)))  # rows of a range; about 4 ranges a task
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id"))
    unit = (F.shiftrightunsigned(hashed, 11).cast("double") / F.lit(float(1 << 53))).alias("_key")
    # one row per source: joined by Spark's own choice, as the number of sources has no bound
    rows = sized.withColumn("_key", unit).join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    ranges = F.ceil(F.col("source_rows") / F.lit(per_range)).cast("long")
    rows = rows.withColumn("_range", F.floor(F.col("_key") * ranges).cast("long"))
    sums = rows.groupBy("source", "_range").agg(F.sum("size").alias("_s"))
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(sums.select(F.col("source").alias("_osource"), F.col("_range").alias("_orange"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off")), "mix-offsets")
    inside = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # at most 4 ranges a task plus one a source: a bounded multiple of the cluster's own size
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("_osource")) & (F.col("_range") == F.col("_orange")))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    start = F.col("_off") + F.col("_in")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), rest - start)).cast("long")
    return rows.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (epochs + F.when((F.col("size") > 0) & (extra == F.col("size")), 1).otherwise(0)).alias("copies"),
        (epochs * F.col("size") + extra).alias("taken"),
    )


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = SEED) -> DataFrame:
    """The mix as documents: each row as often as the mix takes it, columns unchanged.

    Documents stay whole: the one in which a source's budget ends is taken if at least half its
    words fit. Documents without words carry no weight and are left out.
    """
    share = mix(docs, weights, cap, seed)
    times = F.col("copies") + F.when(2 * (F.col("taken") - F.col("copies") * F.col("size")) >= F.col("size"), 1).otherwise(0)
    keys = share.where("size > 0").groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"))
    # repeated rows share what the mix takes of them: _each, and one more for the first _more of them
    times = keys.agg(F.sum(times).alias("_sum"), F.count(F.lit(1)).alias("_n")).where("_sum > 0")
    times = stage(times.select("_id", "_source", "_size", F.expr("_sum div _n").cast("int").alias("_each"), F.expr("_sum % _n").alias("_more")), "mix-times")
    split = stage(times.where("_more > 0"), "mix-split")
    copy = fresh(docs, "copy")
    own = [docs[c] for c in docs.columns]
    key = lambda t: docs["doc_id"].eqNullSafe(t["_id"]) & docs["source"].eqNullSafe(t["_source"])
    taken = lambda n: F.explode(F.sequence(F.lit(1), n)).alias(copy)
    # where rows share unevenly, they are numbered apart: at most one key a source, the one its budget ends in
    uneven = not split.isEmpty()
    even = small(stage(times.where("_more = 0"), "mix-even") if uneven else times)
    out = docs.join(even, key(even) & (word_count(docs["text"]) == even["_size"])).select(*own, taken(even["_each"]))
    if uneven:
        hot = small(split)
        order = Window.partitionBy(hot["_id"], hot["_source"], hot["_size"]).orderBy(F.xxhash64(docs["text"]))
        number = fresh(docs, "number")
        rest = docs.join(hot, key(hot)).where(word_count(docs["text"]) == hot["_size"])
        rest = rest.select(*own, (hot["_each"] + (F.row_number().over(order) <= hot["_more"]).cast("int")).alias(number)).where(F.col(number) > 0)
        out = out.unionByName(rest.select(*docs.columns, taken(F.col(number))))
    return out.select(*docs.columns)
