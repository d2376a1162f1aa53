"""Counts and base scores against dictionaries; the mixture is a distribution and beats the base on held-out texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from episodeframe.llm import interpolation as lm


def words(text):
    return [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


@pytest.mark.parametrize("size", [1 << 21, 50])
@pytest.mark.parametrize("table", ["odd", "tiny"])
def test_scores(table, size, request, monkeypatch):
    monkeypatch.setattr(lm, "BATCH_BYTES", 20_000)
    docs = request.getfixturevalue(table)
    rows = docs.collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    uni, bi = Counter(), Counter()
    for r in rows:
        if not held[r.doc_id]:
            w = words(r.text)
            uni.update(w)
            bi.update(zip([None, *w], w))
    n, v = uni.total(), len(uni)
    seen = {}
    learnt = lm.learn
    monkeypatch.setattr(lm, "learn", lambda *a: seen.setdefault("w", learnt(*a)))
    found = sorted(lm.lm_scores(docs, batch_totals=size).collect(), key=lambda r: r.doc_id)
    assert len(found) == len(rows)
    assert np.allclose(seen["w"].sum(axis=1), 1) and seen["w"][0, 0] == 0
    for r, row in zip(found, sorted(rows, key=lambda r: r.doc_id)):
        w = words(row.text)
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (row.doc_id, held[row.doc_id], len(w), sum(uni[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w))
        total = 0.0
        for a, b in zip([None, *w], w):
            k = seen["w"][uni[a].bit_length()]
            total += math.log10((k[0] * bi[a, b] / uni[a] if uni[a] else 0) + k[1] * uni[b] / n + k[2] / (v + 1))
        assert r.score == pytest.approx(total)


def test_better_than_base_on_held_out(spark):
    found = lm.lm_scores(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").groupBy().sum("base_score", "score").first()
    assert found[1] > found[0]


def test_weights_are_those_of_plain_em(tiny, monkeypatch):
    """Learned weights against EM over every training token by itself, with estimates rounded as the module rounds them."""
    docs = tiny.limit(60)
    rows = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    uni, bi = Counter(), Counter()
    for r in rows:
        w = words(r.text)
        uni.update(w)
        bi.update(zip([None, *w], w))
    n, v = uni.total(), len(uni)
    cells = Counter()
    step = lambda x: round(-lm.GRAIN * math.log2(x)) if x > 0 else None
    for r in rows:
        w = words(r.text)
        for a, b in zip([None, *w], w):
            c = uni[a] - 1
            cells[c.bit_length(), step((bi[a, b] - 1) / c if c else 0), step((uni[b] - 1) / (n - 1))] += 1
    back = lambda q: 2.0 ** (-q / lm.GRAIN) if q is not None else 0.0
    weights = {k[0]: [0.4, 0.4, 0.2] for k in cells} | {0: [0.0, 0.5, 0.5]}
    for _ in range(lm.ROUNDS):
        sums = {k: [0.0] * 3 for k in weights}
        for (k, two, one), m in cells.items():
            part = [x * y for x, y in zip(weights[k], (back(two), back(one), 1 / (v + 1)))]
            for i in range(3):
                sums[k][i] += m * part[i] / sum(part)
        weights |= {k: [x / sum(s) for x in s] for k, s in sums.items() if sum(s)}
    seen = {}
    learnt = lm.learn
    monkeypatch.setattr(lm, "learn", lambda *a: seen.setdefault("w", learnt(*a)))
    lm.lm_scores(docs).count()
    for k in {c[0] for c in cells}:
        assert np.allclose(seen["w"][k], weights[k], atol=1e-6), k


def test_packing():
    rng = np.random.default_rng(1)
    for x in (np.zeros(0), np.zeros(5), rng.integers(0, 1 << 62, 1000), np.array([2**63])):
        assert (lm.expand(lm.squeeze(x.astype(np.uint64))) == x.astype(np.uint64)).all()
    x = np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (lm.expand_sorted(lm.squeeze_sorted(x)) == x).all()


def test_empty(nothing):
    assert lm.lm_scores(nothing).count() == 0
