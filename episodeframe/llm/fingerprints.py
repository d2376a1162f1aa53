"""Document fingerprints from Lempel-Ziv phrases, compared by minimum hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, range_bucket, stage
from .kernels import prefix_hash, span_hash

#: Hashes kept of each phrase set: the standard error of a likeness J is sqrt(J * (1 - J) / 128), 0.044 at most.
KEEP = 128


def phrase_lengths(text: str) -> np.ndarray:
    """Lengths of the LZ78 phrases of a text in order; a last incomplete phrase counts if it is the only one."""
    seen: dict[str, None] = {}
    w = ""
    for ch in text:
        w += ch
        if w not in seen:
            seen[w] = None
            w = ""
    return np.fromiter(map(len, seen), np.int64, len(seen))


def fingerprint(text: str, keep: int = KEEP) -> np.ndarray:
    """The `keep` smallest distinct 32-bit hashes of the phrases, ascending; the empty text has none."""
    ends = np.cumsum(phrase_lengths(text))
    if not len(ends):
        return np.zeros(0, np.uint32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    hashes = span_hash(prefix_hash(points), np.concatenate(([0], ends[:-1])), ends)
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))[:keep]


def likeness(a: np.ndarray, b: np.ndarray, keep: int = KEEP) -> float:
    """Estimated Jaccard similarity of the phrase sets: the share of the union's smallest hashes that both have."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:keep]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


def to_hex(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def from_hex(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint", keep: int = KEEP) -> DataFrame:
    """docs with a fingerprint column: hex of the smallest phrase hashes. Null text counts as empty (fingerprint ''); a column of docs with that name is replaced."""
    docs = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            made = [to_hex(fingerprint(t or "", keep)) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, out])

    from pyspark.sql.types import StringType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(out, StringType()))


def edited_text(text: str, following: str) -> str:
    """The last floor(n/4) code points replaced by the first as many (or all) of the following text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: int = KEEP) -> DataFrame:
    """Fingerprint every text, its edited text, and compare with the next document's.

    Rows: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    The next document is the next by ascending id (ties and repeated rows: by text); after the
    last comes the first; a null id comes first. A single document is its own next. Null text is
    empty. An empty table gives no rows.

    The ids are cut into ranges of about equal counts; each range also receives the first
    document of the range after it, so a task streams through its range in order and holds two
    texts at a time.
    """
    import hashlib

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = range_bucket(rows, "doc_id", max(1, 3 * partitions(spark)))
    # the first document of each range: one (id, text) row a range
    firsts = rows.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("f"))
    heads = stage(firsts.select("bucket", F.col("f.doc_id").alias("first_id")), "lz-heads")
    order = [r[0] for r in heads.select("bucket").orderBy("bucket").collect()]  # one small integer a range
    if not order:
        goes = {}
    else:
        goes = {b: order[i - 1] for i, b in enumerate(order)}
    to = F.create_map(*[F.lit(x) for kv in goes.items() for x in kv]) if goes else F.create_map(F.lit(0), F.lit(0))
    head = heads.select(F.col("bucket").alias("_b"), F.col("first_id").alias("_f"))
    halo = rows.join(F.broadcast(head), (F.col("bucket") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_f")))
    halo = halo.groupBy("bucket", "doc_id").agg(F.min("text").alias("text"))
    halo = halo.select("doc_id", "text", to[F.col("bucket")].alias("bucket"), F.lit(True).alias("halo"))
    every = rows.withColumn("halo", F.lit(False)).unionByName(halo)
    ranged = every.repartitionByRange(max(1, len(order)), "bucket").sortWithinPartitions("bucket", "halo", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (bucket, doc_id, text, fingerprint) of the row before
        for b in batches:
            out: list[tuple] = []
            for i, text, bucket, extra in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last is not None and last[2] == text:
                    own = last[3]
                else:
                    own = fingerprint(text, keep)
                if last is not None and last[0] == bucket:
                    _, j, before, its = last
                    edit = edited_text(before, text)
                    other = its if edit == before else fingerprint(edit, keep)
                    out.append((j, len(before), hashlib.sha256(edit.encode("utf-8", "surrogatepass")).hexdigest(), to_hex(its), to_hex(other), likeness(its, other, keep), likeness(its, own, keep)))
                last = None if extra else (bucket, i, text, own)
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ranged.mapInArrow(run, schema)
