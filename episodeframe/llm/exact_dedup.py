"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stage, unstage

PREFIX_CHARS = 256


def facts(text: Column) -> dict[str, Column]:
    """The two cheap keys of a text: its length in bytes and a hash of its first PREFIX_CHARS characters."""
    return {"_len": F.octet_length(text).cast("long"), "_pre": F.xxhash64(F.substring(text, 1, PREFIX_CHARS))}


def refined(short: DataFrame) -> DataFrame:
    """The rows of a staged table (_len, _pre, ...) whose text may have a copy: lengths that stand once go first,
    then pairs of length and prefix hash. Both levels are counts combined before the shuffle, and only rows without texts are joined."""
    lengths = stage(short.groupBy("_len").count().where("count > 1").select("_len"), "dedup-lengths")
    left = short.join(small(lengths), "_len", "left_semi")
    pairs = stage(left.groupBy("_len", "_pre").count().where("count > 1").select("_len", "_pre"), "dedup-prefixes")
    alive = stage(left.join(small(pairs), ["_len", "_pre"], "left_semi"), "dedup-alive")
    unstage(lengths, pairs)
    return alive


def grouped(alive: DataFrame) -> DataFrame:
    """(_len, _pre, _sha, _keep, _n) of the texts that stand more than once among the rows (_id, _len, _pre, _sha)."""
    found = alive.groupBy("_len", "_pre", "_sha").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    return stage(found.where("_n > 1"), "dedup-groups")


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `<id_col>, keep_id, group_size, kept, text_sha256`.

    Texts are equal when their UTF-8 bytes are; null counts as empty. The largest id of equal
    texts stays. Repeated rows (same id and text) count each, and all of them are kept or dropped
    together. Rows with a null id never win over a row that has one. An empty table gives no rows.
    Columns beyond the two named are not read.

    Lengths that occur once are settled first, then pairs of length and prefix hash; only what is
    left is grouped by its full hash. The digest of every text is a column of the result, so it is
    computed where the text is read, and no text is ever shuffled. A group of any size reaches no single task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stage(docs.select(F.col(id_col).alias("_id"), *(c.alias(n) for n, c in facts(text).items()), F.sha2(text, 256).alias("_sha")), "dedup-rows")
    alive = refined(rows)
    groups = grouped(alive)
    unstage(alive)
    return rows.join(small(groups), ["_len", "_pre", "_sha"], "left").select(
        F.col("_id").alias(id_col),
        F.coalesce("_keep", "_id").alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_keep").isNull() | F.col("_keep").eqNullSafe(F.col("_id"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text a row with a larger id repeats; columns unchanged.

    A row is known by its id and text, as ids may stand with several texts; nulls and repeated rows are
    treated as by exact_copies(), and an empty table stays empty. The full hash is computed only of rows
    that length and prefix hash leave, as long as their keys can be broadcast; beyond that bound it
    is computed of every row where the text is read, rather than shuffling texts, and the groups come from the rows left all the same.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    cheap, sha = facts(text), F.sha2(text, 256)
    short = stage(docs.select(*(c.alias(n) for n, c in cheap.items())), "dedup-rows")
    alive = refined(short)
    pairs = stage(alive.distinct(), "dedup-keys")
    keyed = docs.select(docs[id_col].alias("_id"), *(c.alias(n) for n, c in cheap.items()), text.alias("_text"))
    marked = small(pairs)
    if marked is pairs:
        keyed = keyed.select("_id", "_len", "_pre", F.sha2("_text", 256).alias("_sha")).join(pairs, ["_len", "_pre"], "left_semi")
    else:
        keyed = keyed.join(marked, ["_len", "_pre"], "left_semi").select("_id", "_len", "_pre", F.sha2("_text", 256).alias("_sha"))
    hashed = stage(keyed, "dedup-hashed")
    groups = grouped(hashed)
    gone = hashed.join(small(groups), ["_len", "_pre", "_sha"]).where(~F.col("_keep").eqNullSafe(F.col("_id")))
    gone = stage(gone.select(F.col("_id").alias("_gone"), F.col("_len").alias("_gone_len"), F.col("_pre").alias("_gone_pre"), F.col("_sha").alias("_gone_sha")).distinct(), "dedup-gone")
    unstage(short, alive, pairs, hashed, groups)
    # contains() of two digests is their equality, but no join key: it is computed only where id, length and prefix agree
    gone = small(gone)
    same = docs[id_col].eqNullSafe(gone["_gone"]) & (cheap["_len"] == gone["_gone_len"]) & (cheap["_pre"] == gone["_gone_pre"])
    return docs.join(gone, same & F.contains(gone["_gone_sha"], sha), "left_anti")
