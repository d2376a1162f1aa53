"""Embedding whitening against plain integer loops and another eigensolver."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from episodeframe.llm import queries, whitening

NAN, INF = float("nan"), float("inf")


def brute(rows, scale=64, offset=1_000_000, top=16):
    """id -> (n, deviation, |whitened| by component, explained) by loops over integers and fractions; one length of vector."""
    kept = [(i, tuple(math.floor(scale * c) + offset for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    total = [sum(x[j] for x in fit) for j in range(d)]
    cov = np.array([[float(Fraction(sum((n * x[i] - total[i]) * (n * x[j] - total[j]) for x in fit), n**3)) for j in range(d)] for i in range(d)])
    u, e, _ = np.linalg.svd(cov)
    out = []
    for i, x in kept:
        t = np.array([float(Fraction(n * x[j] - total[j], n)) for j in range(d)])
        out.append((i, n, sum((n * x[j] - total[j]) ** 2 for j in range(d)), [abs(t @ u[:, k]) / math.sqrt(e[k]) if e[k] > 1e-13 * e[0] else 0 for k in range(min(top, d))], [e[k] / e.sum() for k in range(min(top, d))]))
    return out


def compare(got, want):
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    assert set(by) == {w[0] for w in want}
    for i, n, deviation, values, explained in want:
        rows = sorted(by[i], key=lambda r: r["component"])
        times = sum(w[0] == i for w in want)
        assert [r["component"] for r in rows] == [k + 1 for k in range(len(values)) for _ in range(times)]
        assert {(r["n"], r["deviation_text"]) for r in rows} == {(n, str(deviation))}
        assert {r["deviation"] for r in rows} == {deviation if deviation < 2**63 else None}
        for r in rows:
            assert abs(abs(r["whitened"]) - values[r["component"] - 1]) <= 1e-8 * max(1, values[r["component"] - 1])
            assert abs(r["explained"] - explained[r["component"] - 1]) <= 1e-9
            assert r["identity_error"] <= 1e-8


def frame(spark, rows):
    return spark.createDataFrame([(i, v and [c if c is None else float(c) for c in v], "x", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, dims int")


def test_whole_table(spark):
    got = queries.op11_embedding_whitening(spark, "/root/testdata/sf0.001").collect()
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    want = brute([(r["vec_id"], [float(c) for c in r["embedding"]]) for r in table.collect()])
    assert len(got) == table.count() * 16
    compare(got, want)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(40)]
    rows += [(50, rows[0][1]), (50, rows[0][1]), (51, [NAN] * 5), (52, None), (53, [1.0, None, 1.0, 1.0, 1.0]), (54, [1, 2, 3, 4, INF]), (55, []), (56, [1.0, 1.0, 1.0, 1.0, -1000.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    compare(got, brute(rows))


@pytest.mark.parametrize("size", [1e3, 1e9, 1e15])
def test_sizes_of_integers(spark, size):
    """From one limb to Python integers."""
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=3) * size).tolist()) for i in range(30)]
    compare(whitening.whiten(frame(spark, rows)).collect(), brute(rows))


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for bits in (1, 19, 20, 39, 40, 61):
        values = rng.integers(-(1 << bits) + 1, 1 << bits, (9000, 2))
        found = whitening.Products(2, bits)
        found.add(values)
        found.flush()
        plain = values.astype(object)
        assert (found.total == plain.T.dot(plain)).all()
    assert whitening.undigits(dict(enumerate(whitening.digits([-(2**70) + 3, 5, 2**64], 3))), 3, 3) == [-(2**70) + 3, 5, 2**64]


def test_equal_empty_null_ids_and_other_lengths(spark, nothing):
    same = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(same) == 4 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(1, 0, 0.0, 0.0, 0.0)}
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [0.5])]).where("false")).collect() == []
    mixed = whitening.whiten(frame(spark, [(None, [1.0]), (2, [3.0]), (3, [1.0, 5.0]), (4, [2.0, 7.0])])).collect()
    assert sorted((str(r["vec_id"]), r["component"], r["n"]) for r in mixed) == [("2", 1, 2), ("3", 1, 2), ("3", 2, 2), ("4", 1, 2), ("4", 2, 2), ("None", 1, 2)]
    assert {round(abs(r["whitened"]), 9) for r in mixed if r["component"] == 1} == {1.0}
