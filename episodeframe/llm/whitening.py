"""Embedding whitening by digit slices: exact integer moments with float64 matrix products.

Entries become integers. A block of centred integers is cut into short limbs, so that products of limb
matrices are exact in float64; the products are put together again as big integers, which tasks send as
base 2**32 digits that Spark adds up. Only then is anything rounded: one d x d covariance is decomposed on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Rows of a block and bits of a limb: ROWS * 2**(2 * LIMB) stays below 2**53, so float64 products of limbs are exact.
ROWS, LIMB = 1 << 12, 20
#: Limb products of so many blocks are added as 64-bit integers before they become big integers.
FLUSH = 64
#: Bits of a digit in which big integers travel.
DIGIT = 32
#: An entry times the scale is held to this, so that it fits a long.
LARGEST = 2.0**62
#: Components with a variance below this share of the largest have none, as far as doubles can tell.
NOTHING = 1e-13


@dataclass(frozen=True)
class Whitening:
    """What the fit list of one length has: its size, exact sums, components (columns) with variances, and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    bits: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: int64 while that holds it, else Python integers."""
        kind = np.int64 if self.bits < 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(self.variances > 0, 1 / np.sqrt(np.where(self.variances > 0, self.variances, 1)), 0)
        return (self.centred(x) / self.n).astype(float) @ self.components * scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum of squares of each row of centred(x)."""
        parts = limbs(self.centred(x), self.bits)
        total = np.zeros(len(x), object)
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total = total + (np.einsum("ij,ij->i", a, b).astype(np.int64).astype(object) << (LIMB * (i + j)))
        return total.tolist()


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """values = sum of limb[k] * 2**(LIMB * k): float64 matrices of LIMB bits, the last one signed. bits: of the largest value."""
    count = bits // LIMB + 1
    cut = [((values >> (LIMB * k)) & ((1 << LIMB) - 1) if k < count - 1 else values >> (LIMB * k)) for k in range(count)]
    return [c.astype(float) for c in cut]


class Products:
    """The exact sum of outer products of integer rows."""

    def __init__(self, width: int, bits: int):
        self.bits, self.seen, self.total = bits, 0, np.zeros((width, width), object)
        self.small = np.zeros((2 * (bits // LIMB + 1) - 1, width, width), np.int64)

    def add(self, values: np.ndarray) -> None:
        for a in range(0, len(values), ROWS):
            parts = limbs(values[a : a + ROWS], self.bits)
            for i, left in enumerate(parts):
                for j in range(i + 1):
                    product = (left.T @ parts[j]).astype(np.int64)
                    self.small[i + j] += product if i == j else product + product.T
            self.seen += 1
            if self.seen % FLUSH == 0:
                self.flush()

    def flush(self) -> None:
        for power, part in enumerate(self.small):
            self.total = self.total + (part.astype(object) << (LIMB * power))
        self.small[:] = 0


def digits(values: list[int], count: int) -> list[int]:
    """Each integer as `count` digits of DIGIT bits, the last one signed; digits of sums are sums of digits."""
    mask = (1 << DIGIT) - 1
    return [(v >> (DIGIT * k)) & mask if k < count - 1 else v >> (DIGIT * k) for v in values for k in range(count)]


def undigits(found: dict[int, int], width: int, count: int) -> list[int]:
    return [sum(int(found[i * count + k]) << (DIGIT * k) for k in range(count)) for i in range(width)]


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int, offset: int) -> DataFrame:
    """(id, x, dims): the vectors whose entries are all there and finite, as integers floor(scale * entry) + offset."""
    vector = F.col(vector_col)
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    held = lambda c: F.greatest(F.least(c.cast("double") * scale, F.lit(LARGEST)), F.lit(-LARGEST))
    x = F.transform(vector, lambda c: F.floor(held(c)).cast("long") + F.lit(offset).cast("long"))
    kept = vectors.where(vector.isNotNull() & whole & (F.size(vector) > 0))
    return kept.select(F.col(id_col).alias("id"), x.alias("x"), F.size(vector).alias("dims"))


def matrices(column: pa.Array, dims: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, rows as a matrix) for each length of vector in a batch."""
    flat = np.asarray(column.flatten())
    start = np.concatenate(([0], np.cumsum(dims)))
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield int(d), at, flat[start[at][:, None] + np.arange(d)]


PARTS = "dims int, row int, n long, low long, high long, digits array<long>"


def merged(parts: DataFrame) -> list:
    """Digits of equal place added up over all tasks, counts too: at most d * d rows of a few digits come back for vectors of d entries."""
    each = parts.select("dims", "row", "n", "low", "high", F.posexplode("digits").alias("place", "digit"))
    return each.groupBy("dims", "row", "place").agg(F.sum("digit").alias("digit"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()


def sums(fit: DataFrame) -> dict[int, tuple[int, list[int], int]]:
    """For each length of vector: the size of the fit list, exact sums, and the bits of the largest n * x - sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            for d, _, x in matrices(b.column(0), np.asarray(b.column(1))):
                now = found.setdefault(d, [0, None, None, np.zeros(d, object)])
                now[0] += len(x)
                now[1] = int(x.min()) if now[1] is None else min(now[1], int(x.min()))
                now[2] = int(x.max()) if now[2] is None else max(now[2], int(x.max()))
                low, high = x & ((1 << DIGIT) - 1), x >> DIGIT
                now[3] = now[3] + low.sum(axis=0).astype(object) + (high.sum(axis=0).astype(object) << DIGIT)
        rows = [{"dims": d, "row": 0, "n": n, "low": low, "high": high, "digits": digits(total.tolist(), 4)} for d, (n, low, high, total) in found.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("dims", pa.int32()), ("row", pa.int32()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("digits", pa.list_(pa.int64()))]))

    by: dict[int, list] = {}
    for r in merged(fit.select("x", "dims").mapInArrow(run, PARTS)):
        by.setdefault(r["dims"], []).append(r)
    out = {}
    for d, rows in by.items():
        n, low, high = rows[0]["n"], rows[0]["low"], rows[0]["high"]
        total = undigits({r["place"]: r["digit"] for r in rows}, d, 4)
        most = max(max(n * high - s, s - n * low) for s in total)
        out[d] = (n, total, max(1, int(most).bit_length()))
    return out


def fitted(fit: DataFrame, top: int) -> dict[int, Whitening]:
    """The whitening of each length of vector over a staged fit list (x, dims)."""
    first = {d: Whitening(n, total, np.zeros((d, 0)), np.zeros(0), 0.0, bits) for d, (n, total, bits) in sums(fit).items()}
    count = {d: (2 * w.bits + w.n.bit_length() + 2) // DIGIT + 1 for d, w in first.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Products] = {}
        for b in batches:
            for d, _, x in matrices(b.column(0), np.asarray(b.column(1))):
                found.setdefault(d, Products(d, first[d].bits)).add(first[d].centred(x))
        for d, products in found.items():
            products.flush()
            rows = [digits(products.total[i, i:].tolist(), count[d]) for i in range(d)]
            zero = pa.array([0] * d, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), zero, zero, zero, pa.array(rows, pa.list_(pa.int64()))], names=["dims", "row", "n", "low", "high", "digits"])

    by: dict[tuple, dict] = {}
    for r in merged(fit.select("x", "dims").mapInArrow(run, PARTS)):
        by.setdefault((r["dims"], r["row"]), {})[r["place"]] = r["digit"]
    out = {}
    for d, w in first.items():
        upper = [undigits(by[d, i], d - i, count[d]) for i in range(d)]
        cube = w.n**3  # the sum of (n x - S)(n x - S)' is n**3 times the covariance; one correctly rounded division each
        v = np.array([[upper[min(i, j)][abs(i - j)] / cube for j in range(d)] for i in range(d)])
        e, vectors = np.linalg.eigh(v)
        e, vectors = e[::-1][:top], vectors[:, ::-1][:, :top]
        e = np.where(e > NOTHING * max(e[0], 0), e, 0.0)
        out[d] = Whitening(w.n, w.sums, vectors, e, sum(upper[i][0] for i in range(d)) / cube, w.bits)
    return out


def identity_errors(fit: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, over components that have variance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in matrices(b.column(0), np.asarray(b.column(1))):
                w = models[d].whitened(x)
                found[d] = found.get(d, 0) + np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))
        kinds = [pa.array(list(found), pa.int32()), pa.array([x.tolist() for x in found.values()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(kinds, names=["dims", "sums"])

    added = fit.select("x", "dims").mapInArrow(run, "dims int, sums array<double>").select("dims", F.posexplode("sums").alias("place", "value"))
    by: dict[int, dict] = {}
    for r in added.groupBy("dims", "place").agg(F.sum("value").alias("value")).collect():
        by.setdefault(r["dims"], {})[r["place"]] = r["value"]
    out = {}
    for d, m in models.items():
        k = len(m.variances)
        found = np.array([by[d][i] for i in range(k + k * k)]) / m.n
        error = found[k:].reshape(k, k) - np.outer(found[:k], found[:k]) - np.eye(k)
        has = m.variances > 0
        out[d] = float(np.abs(error[has][:, has]).max()) if has.any() else 0.0
    return out


def projected(rows: DataFrame, models: dict[int, Whitening], errors: dict[int, float]) -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error) of rows (id, x, dims); deviation is the exact integer as text."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in matrices(b.column(1), np.asarray(b.column(2))):
                m, n = models[d], len(at)
                share = (m.variances / m.trace if m.trace else m.variances).tolist()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), pa.array([m.n] * n, pa.int64()), pa.array(map(str, m.deviations(x)), pa.string()), pa.array(m.whitened(x).tolist(), pa.list_(pa.float64())), pa.array([share] * n, pa.list_(pa.float64())), pa.array([errors[d]] * n, pa.float64())],
                    names=["id", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, f"id {kind}, n long, deviation string, whitened array<double>, explained array<double>, identity_error double")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, offset: int = 1_000_000, top: int = 16) -> DataFrame:
    """One row per usable row and component: `<id_col>, component, n, deviation, whitened, explained, identity_error, deviation_text`.

    Entries become x = floor(scale * entry) + offset. The fit list has each distinct x once: n vectors with sums S.
    Components are the unit eigenvectors of its covariance (divisor n), from 1 by falling variance e, at most `top`.
    `whitened` is (x - S / n) on the component over sqrt(e), `explained` e over the trace, `deviation` the exact sum of
    (n x - S)^2 over the entries: as a long, null if it is beyond one, and as text at any size. `identity_error` is
    one value, the largest absolute entry of the whitened fit list's covariance minus the identity.

    Rows whose vector is null, empty, or has a null or non-finite entry are dropped; a null id is kept. Repeated rows come
    back each, and count once in the fit. Entries beyond 2**62 / scale count as that. Vectors of another length are a space of
    their own, with their own fit; every length has one d x d matrix on the driver. A component without variance has whitened 0 and is
    left out of identity_error. Columns beyond the two named are not read, and an empty table gives no rows.

    What is shuffled: the integer vectors once, for the fit list (repeats are combined before the shuffle), and d * d digits a task.
    """
    rows = integers(vectors, id_col, vector_col, scale, offset)
    fit = stage(rows.select("x", "dims").distinct(), "whiten-fit")
    models = fitted(fit, top)
    found = projected(rows, models, identity_errors(fit, models))
    each = found.select("id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        F.col("id").alias(id_col),
        (F.col("place") + 1).cast("int").alias("component"),
        "n",
        F.col("deviation").try_cast("long").alias("deviation"),
        "whitened",
        F.element_at("explained", F.col("place") + 1).alias("explained"),
        "identity_error",
        F.col("deviation").alias("deviation_text"),
    )
