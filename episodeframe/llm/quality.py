"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage
from .kernels import LOWER, U, chunks, list_array, mix, prefix_hash, span_hash, strings, words

#: Hashed feature space.
SPACE = 1 << 20
#: Most labelled documents the model is fitted on, drawn by the hash of their ids.
FIT_ROWS = 16384
#: A feature needs so many fitted documents to get a weight.
LEAST_DOCUMENTS = 5
#: ... and so large a chi-square of presence against grade: the many chance features of long texts get none.
LEAST_CHI = 16.0
#: Bytes of the word beginnings that are features of their own.
STEMS = (4, 5, 6, 7)
#: Upper ends of the bands into which the shares of unusual words fall.
SHARES = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.4])

_UPPER, _LETTER, _INNER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_INNER[:] = _LETTER
_INNER[48:58] = True


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct hashed features of each document of a chunk.

    The lower-cased words without outer punctuation, how longer ones begin, and for each kind of unusual word (capitals,
    punctuation runs, no letters, repeats of the word before, seen before) the band its share is in.
    """
    start, end, first = words(data, offsets)
    inner = _INNER[data]
    at = np.arange(len(data) + 1)
    nxt = np.append(np.where(inner, at[:-1], len(data)), len(data))
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    prv = np.maximum.accumulate(np.concatenate(([0], np.where(inner, at[1:], 0))))
    a = np.minimum(nxt[start], end)
    b = np.maximum(prv[end], a)
    sums = prefix_hash(LOWER[data])
    h = span_hash(sums, a, b)
    stems = [(span_hash(sums, a, np.minimum(a + n, b)) ^ U(n), b - a > n) for n in STEMS]
    upper, letter = (np.concatenate(([0], np.cumsum(t[data]))) for t in (_UPPER, _LETTER))
    letters = letter[end] - letter[start]
    odd = [
        (letters >= 2) & (upper[end] - upper[start] == letters),
        (end - b) + (a - start) >= 2,
        letters == 0,
        np.concatenate(([False], h[1:] == h[:-1]))[: len(h)],
    ]
    out = []
    for i in range(len(offsets) - 1):
        x, y = int(first[i]), int(first[i + 1])
        own = np.unique(h[x:y])
        shares = [f[x:y].mean() if y > x else 0.0 for f in odd] + [1 - len(own) / (y - x) if y > x else 0.0]
        bands = np.searchsorted(SHARES, shares)
        size = min(int(y - x).bit_length(), 8)
        bands = np.concatenate((bands * 5 + np.arange(5) + 1000, [bands[4] * 10 + size + 2000, size + 3000]))
        starts = [np.unique(v[x:y][longer[x:y]]) for v, longer in stems]
        out.append(np.unique((np.concatenate((own, *starts, mix(bands.astype(U)))) & U(SPACE - 1)).astype(np.int32)))
    return out


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade <= j) = sigmoid(cuts[j] - weights . x) with ascending cuts; x marks the features present."""

    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, xs: list[np.ndarray]) -> np.ndarray:
        """P(grade > j) for each document (rows) and cut (columns)."""
        s = np.array([self.weights[x].sum() for x in xs])
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - s[:, None], -60, 60)))


def ordered_cuts(z: np.ndarray) -> np.ndarray:
    """Ascending cuts: the first one, and exp() of the steps after it."""
    return np.concatenate(([z[0]], z[0] + np.cumsum(np.exp(z[1:]))))


def loss_and_gradient(w: np.ndarray, z: np.ndarray, row: np.ndarray, col: np.ndarray, grades: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood with the ridge penalty, and its gradient by weights, then by z; feature col[i] is present in row[i]."""
    n, top = len(grades), len(z)
    s = np.bincount(row, w[col], minlength=n)
    edge = np.concatenate(([-np.inf], ordered_cuts(z), [np.inf]))
    hi, lo = (1 / (1 + np.exp(np.clip(s - edge[grades + d], -60, 60))) for d in (1, 0))
    p = np.maximum(hi - lo, 1e-9)
    dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
    g = np.zeros(len(w) + top)
    g[: len(w)] = np.bincount(col, (dhi - dlo)[row], minlength=len(w)) / n + decay * w
    gc = np.array([-dhi[grades == j].sum() + dlo[grades == j + 1].sum() for j in range(top)]) / n
    tail = gc[::-1].cumsum()[::-1]
    g[len(w)] = tail[0]
    g[len(w) + 1 :] = tail[1:] * np.exp(z[1:])
    return float(-np.log(p).mean() + decay / 2 * (w * w).sum()), g


def fit(xs: list[np.ndarray], grades: np.ndarray, steps: int = 300, rate: float = 0.05, decay: float = 2e-4) -> OrdinalModel:
    """Maximum likelihood with a ridge penalty by Adam over all rows at once.

    The cuts are a first one plus exp() of steps, so they stay ordered. Grades are 0..K-1; with
    one grade only, every document gets that grade with certainty.
    """
    top = int(grades.max()) if len(grades) else 0
    weights = np.zeros(SPACE, np.float32)
    if len(np.unique(grades)) < 2:
        return OrdinalModel(weights, np.full(max(top, 1), -60.0 if top else 60.0))
    flat = np.concatenate(xs)
    row = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    seen = np.array([np.bincount(flat[grades[row] == j], minlength=SPACE) for j in range(top + 1)])
    counts, size = seen.sum(axis=0), np.bincount(grades, minlength=top + 1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        expect = counts * (size / len(xs))
        absent = (len(xs) - counts) * (size / len(xs))
        chi = np.nansum((seen - expect) ** 2 * (1 / expect + np.where(absent > 0, 1 / absent, 0)), axis=0)
    keep = (counts >= LEAST_DOCUMENTS) & (chi >= LEAST_CHI)
    names = np.flatnonzero(keep)
    index = np.full(SPACE, -1)
    index[names] = np.arange(len(names))
    col, row = index[flat[keep[flat]]], row[keep[flat]]
    w = np.zeros(len(names))
    share = np.clip(np.array([(grades <= j).mean() for j in range(top)]), 1e-3, 1 - 1e-3)
    level = np.log(share / (1 - share))
    z = np.concatenate(([level[0]], np.log(np.maximum(np.diff(level), 1e-2))))
    m1, m2 = np.zeros(len(w) + top), np.zeros(len(w) + top)
    for t in range(1, steps + 1):
        _, g = loss_and_gradient(w, z, row, col, grades, decay)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w -= step[: len(w)]
        z -= step[len(w) :]
    weights[names] = w
    return OrdinalModel(weights, ordered_cuts(z))


def featured(docs: DataFrame, text_col: str = "text", keep: str = "doc_id long") -> DataFrame:
    """The first column of docs and the features of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = strings(b.column(1))
            for i, j in chunks(offsets):
                xs = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), list_array(xs, pa.int32())], names=[b.schema.names[0], "features"])

    return docs.mapInArrow(run, f"{keep}, features array<int>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> OrdinalModel:
    """Fit on at most fit_rows labelled documents, chosen by the hash of their ids.

    The grade is quality + 1 - toxic, 0 to 2: 2 for good and harmless, 0 for poor and toxic.
    Labels with a null in any column, and labels without a document, are passed over; of several labels of
    one id the least grade counts. Null texts count as empty. Rows that repeat an id are all fitted on; which
    labels are drawn follows from the hashes of distinct ids, so there are no ties. An empty table gives a model that grades everything 0.
    """
    graded = labels.dropna(subset=["doc_id", "quality", "toxic"]).groupBy("doc_id").agg(F.min(F.col("quality") + 1 - F.col("toxic")).cast("int").alias("_grade"))
    chosen = stage(graded.orderBy(F.xxhash64("doc_id")).limit(fit_rows).withColumnRenamed("doc_id", "_labelled"), "quality-labels")
    # fit_rows bounds this broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("id") == F.col("_labelled")).select(F.struct("id", "_grade").alias("key"), "text")
    table = stage(featured(rows, keep="key struct<id: long, _grade: int>").select("key.*", "features"), "quality-features")
    # the test of fit() on counts, here to send only the features that pass it; SPACE bounds their number
    sizes = dict(table.groupBy("_grade").count().collect())
    n = sum(sizes.values())
    seen = table.select("_grade", F.explode("features").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("c"), *(F.count_if(F.col("_grade") == g).alias(f"c{g}") for g in sizes))
    share = {g: sizes[g] / n for g in sizes}
    gap = [(F.col(f"c{g}") - F.col("c") * share[g]) ** 2 / share[g] for g in sizes]
    both = sum(gap, F.lit(0.0)) * (1 / F.col("c") + F.when(F.col("c") < n, 1 / (n - F.col("c"))).otherwise(0.0))
    kept = np.sort(seen.where((F.col("c") >= LEAST_DOCUMENTS) & (both >= 0.99 * LEAST_CHI)).select("f").toArrow().column("f").to_numpy())

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = [np.asarray(x.values) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), list_array([x[np.isin(x, kept)] for x in xs], pa.int32())], names=b.schema.names)

    found = table.mapInArrow(narrowed, table.schema).orderBy("id", "_grade").toArrow()
    unstage(chosen, table)
    xs = [np.asarray(x.values) for x in found.column("features")] if found.num_rows else []
    return fit(xs, found.column("_grade").to_numpy().astype(np.int64) if found.num_rows else np.zeros(0, np.int64))


def graded(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, p_above_0, ..., p_top (probability of the highest grade) of every whole text.

    Null text counts as empty, and the empty text is graded like any other; repeated rows each
    give a row; other columns are not read.
    """
    levels = len(model.cuts)
    names = [*(f"p_above_{j}" for j in range(levels - 1)), "p_top"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = strings(b.column(1))
            for i, j in chunks(offsets):
                p = model.tails(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(p.sum(axis=1)), *(pa.array(p[:, k].copy()) for k in range(levels))], names=["doc_id", "expected_grade", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, expected_grade double, " + ", ".join(f"{n} double" for n in names))


def keep_good(docs: DataFrame, model: OrdinalModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs whose probability of the highest grade is at least `least`; columns unchanged, rows never shuffled.

    Null text counts as empty and is graded like any text; rows that repeat a text stay or go together, a
    probability equal to `least` stays; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = strings(b.column(b.schema.get_field_index(text_col)))
            keep = [model.tails(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))[:, -1] >= least for i, j in chunks(offsets)]
            yield b.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
