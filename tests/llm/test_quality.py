"""The ordinal model: held-out accuracy, ordered tails, odd tables."""

import numpy as np
from pyspark.sql import functions as F

from episodeframe.llm import quality


def test_fit_recovers_order():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 3, 3000)
    xs = [np.unique(np.concatenate((rng.integers(100, 400, 10), rng.integers(10 * g, 10 * g + 10, 3)))).astype(np.int32) for g in grades]
    model = quality.fit(xs[:2000], grades[:2000])
    tails = model.tails(xs[2000:])
    assert (np.diff(model.cuts) > 0).all() and (tails[:, 0] >= tails[:, 1]).all()
    assert ((tails >= 0.5).sum(axis=1) == grades[2000:]).mean() > 0.9


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fitted, held = labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 > 0), labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 == 0)
    model = quality.train(docs, fitted)
    found = quality.graded(docs, model).join(held, "doc_id").select("p_top", "quality", "toxic").collect()
    good = [r.p_top for r in found if r.quality == 1 and r.toxic == 0]
    rest = [r.p_top for r in found if not (r.quality == 1 and r.toxic == 0)]
    assert np.mean(np.array(good) >= 0.5) > 0.9
    assert np.mean(np.array(rest) < 0.5) > 0.6


def test_odd_tables(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, 0), (5, 0, 0), (8, 1, 0), (99, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels)
    found = quality.graded(odd, model)
    assert found.count() == odd.count()
    assert quality.keep_good(odd, model, 0.0).collect() == odd.collect()
    assert quality.graded(nothing, model).count() == quality.keep_good(nothing, model).count() == 0
    unfit = quality.train(nothing, labels)
    assert quality.graded(odd, unfit).count() == odd.count()


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(2)
    n, m = 40, 6
    grades, row, col = rng.integers(0, 3, n), np.repeat(np.arange(n), 3), rng.integers(0, m, 3 * n)
    w, z = rng.normal(size=m), np.array([-0.5, 0.3])
    loss = lambda v: quality.loss_and_gradient(v[:m], v[m:], row, col, grades, 0.01)[0]
    at = np.concatenate((w, z))
    told = quality.loss_and_gradient(w, z, row, col, grades, 0.01)[1]
    step = 1e-6 * np.eye(m + 2)
    assert np.allclose(told, [(loss(at + e) - loss(at - e)) / 2e-6 for e in step], atol=1e-6)
    # ... and the likelihood is that of the cumulative-link model
    cuts, s = np.array([-0.5, -0.5 + np.exp(0.3)]), np.bincount(row, w[col], minlength=n)
    below = 1 / (1 + np.exp(s[:, None] - cuts))
    p = np.diff(np.concatenate((np.zeros((n, 1)), below, np.ones((n, 1))), axis=1), axis=1)[np.arange(n), grades]
    assert loss(at) == -np.log(p).mean() + 0.005 * (w * w).sum() or abs(loss(at) + np.log(p).mean() - 0.005 * (w * w).sum()) < 1e-9


def plain_features(text):
    """The same features word by word, hashed by the kernels one string at a time."""
    import re

    from episodeframe.llm import kernels as k

    def hashed(part):
        raw = np.frombuffer(part.lower().encode() if part.isascii() else "".join(c.lower() if c.isascii() else c for c in part).encode(), np.uint8)
        return int(k.span_hash(k.prefix_hash(raw), np.array([0]), np.array([len(raw)]))[0])

    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    inner = lambda b: bytes([b]).isalnum() or b >= 128
    own, starts, odd, before = set(), set(), [[], [], [], []], None
    for w in words:
        raw = w.encode()
        at = [i for i, b in enumerate(raw) if inner(b)]
        a, b = (at[0], at[-1] + 1) if at else (len(raw), len(raw))
        core = raw[a:b]
        h = int(k.span_hash(k.prefix_hash(k.LOWER[np.frombuffer(core, np.uint8)]), np.array([0]), np.array([len(core)]))[0])
        own.add(h)
        for n in quality.STEMS:
            if len(core) > n:
                stem = k.LOWER[np.frombuffer(core[:n], np.uint8)]
                starts.add((n, int(k.span_hash(k.prefix_hash(stem), np.array([0]), np.array([n]))[0]) ^ n))
        letters = sum(chr(c).isalpha() if c < 128 else True for c in raw)
        upper = sum(65 <= c < 91 for c in raw)
        for kind, flag in zip(odd, (letters >= 2 and upper == letters, len(raw) - b + a >= 2, letters == 0, h == before), strict=True):
            kind.append(flag)
        before = h
    shares = [sum(f) / len(f) if f else 0.0 for f in odd] + [1 - len(own) / len(words) if words else 0.0]
    bands = [int(np.searchsorted(quality.SHARES, x)) for x in shares]
    size = min(len(words).bit_length(), 8)
    codes = [b * 5 + i + 1000 for i, b in enumerate(bands)] + [bands[4] * 10 + size + 2000, size + 3000]
    found = own | {h for _, h in starts} | set(map(int, k.mix(np.array(codes, np.uint64))))
    return sorted({f & (quality.SPACE - 1) for f in found})


def test_features_against_a_plain_loop(tiny):
    from episodeframe.llm import kernels as k

    texts = [r.text or "" for r in tiny.limit(40).collect()] + ["", "ONE two, TWO!! (three) three three ... 12 ab1", "naïve ÉTÉ  x"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(t) for t in raw])
    found = quality.features(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for t, f in zip(texts, found, strict=True):
        assert f.tolist() == plain_features(t), t[:60]


def plain_model(rows, steps=300, rate=0.05, decay=2e-4):
    """(weights by feature, cuts) of graded feature sets by loops over documents: the likelihood's gradient and Adam, nothing shared with the operator."""
    from math import exp, log, sqrt

    n = len(rows)
    count = {}
    for xs, g in rows:
        for f in xs:
            count.setdefault(f, [0, 0, 0])[g] += 1
    size = [sum(g == j for _, g in rows) for j in range(3)]

    def chi(c):
        total = sum(c)
        out = 0.0
        for j in range(3):
            for have, all_ in ((c[j], total), (size[j] - c[j], n - total)):
                want = all_ * size[j] / n
                out += (have - want) ** 2 / want if want else 0.0
        return out

    names = sorted(f for f, c in count.items() if sum(c) >= quality.LEAST_DOCUMENTS and chi(c) >= quality.LEAST_CHI)
    own = [([names.index(f) for f in xs if f in set(names)], g) for xs, g in rows]
    share = [min(max(sum(size[: j + 1]) / n, 1e-3), 1 - 1e-3) for j in range(2)]
    level = [log(s / (1 - s)) for s in share]
    v = [0.0] * len(names) + [level[0], log(max(level[1] - level[0], 1e-2))]
    one, two = [0.0] * len(v), [0.0] * len(v)
    sigmoid = lambda x: 1 / (1 + exp(-x)) if x > -700 else 0.0
    for t in range(1, steps + 1):
        cuts = [v[-2], v[-2] + exp(v[-1])]
        grad = [decay * w for w in v[:-2]] + [0.0, 0.0]
        for xs, g in own:
            s = sum(v[i] for i in xs)
            high = sigmoid(cuts[g] - s) if g < 2 else 1.0
            low = sigmoid(cuts[g - 1] - s) if g else 0.0
            p = max(high - low, 1e-9)
            dh, dl = high * (1 - high) / p, low * (1 - low) / p
            for i in xs:
                grad[i] += (dh - dl) / n
            for cut, d in ((g, -dh), (g - 1, dl)):
                if 0 <= cut < 2:
                    grad[-2] += d / n
                    if cut == 1:
                        grad[-1] += d / n * exp(v[-1])
        for i, x in enumerate(grad):
            one[i] = 0.9 * one[i] + 0.1 * x
            two[i] = 0.999 * two[i] + 0.001 * x * x
            v[i] -= rate * (one[i] / (1 - 0.9**t)) / (sqrt(two[i] / (1 - 0.999**t)) + 1e-8)
    return dict(zip(names, v)), [v[-2], v[-2] + exp(v[-1])]


def test_query_against_plain_loops(spark):
    """The query's own result on a whole table: features, fit and grades by loops."""
    from math import exp

    from episodeframe.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    grade = {r.doc_id: r.quality + 1 - r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in docs}
    sets = {i: plain_features(t) for i, t in docs.items()}
    weights, cuts = plain_model([(sets[i], grade[i]) for i in sorted(grade)])
    got = queries.op3_quality_classifier(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs) and len(weights) > 10
    for r in got:
        s = sum(weights.get(f, 0.0) for f in sets[r.doc_id])
        above, top = (1 / (1 + exp(c - s)) for c in cuts)
        assert abs(r.p_above_0 - above) < 1e-4 and abs(r.p_top - top) < 1e-4 and abs(r.expected_grade - above - top) < 2e-4
        assert r.kept == (r.p_top >= 0.5)
