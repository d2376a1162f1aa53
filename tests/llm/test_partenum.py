"""Components against all pairs of sets."""

import re

import numpy as np
import pytest

from episodeframe.llm import partenum


def shingles(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(s), least[find(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("k,percent,block", [(3, 90, 2048), (5, 80, 4)])
@pytest.mark.parametrize("table", ["odd", "tiny"])
def test_components(table, k, percent, block, request):
    docs = request.getfixturevalue(table)
    found = partenum.similarity_components(docs, k, percent, block=block)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == brute([(r.doc_id, r.text) for r in docs.collect()], k, percent)


def test_near_copies(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 500, 40 + 12 * g)]
        for _ in range(8):
            text = list(base)
            for at in rng.integers(0, len(text), rng.integers(0, 4)):
                text[at] = f"new{rng.integers(0, 99)}"
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((3, 90), (5, 80)):
        found = partenum.similarity_components(docs, k, percent, block=16)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == brute(rows, k, percent)


def test_signatures_share_within_distance():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate((rng.permutation(a)[: max(1, len(a) - rng.integers(0, 8))], rng.integers(0, 1 << 63, rng.integers(0, 8)).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        for percent in (80, 90):
            if 100 * both >= percent * (len(a) + len(b) - both):
                assert len(np.intersect1d(partenum.signatures(a, percent), partenum.signatures(b, percent)))


def test_layouts_use_both_levels():
    """Subsets of more than one second-level partition where it pays; n1, k2 and spare keep the promise of agreement."""
    seen = set()
    for percent in (80, 90):
        for size in (1, 2, 5, 10, 20, 50, 100, 300, 1000, 5000):
            k = int(partenum.distance(percent, 2 * size))
            n1, n2, spare, subsets = partenum.layout(k, size)
            k2 = n2 - len(subsets[0])
            assert n1 - k // (k2 + 1) == 1 + spare and len(subsets) == len(set(subsets))
            seen.add((n2, len(subsets[0])))
    assert any(chosen >= 2 for _, chosen in seen) and any(n2 == 1 for n2, _ in seen)


def test_plausible_never_fails_a_link():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate((rng.permutation(a)[: max(1, len(a) - rng.integers(0, n // 6 + 1))], rng.integers(0, 1 << 63, rng.integers(0, n // 10 + 1)).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        for percent in (80, 90):
            if 100 * both >= percent * (len(a) + len(b) - both):
                near = partenum.plausible(np.array([len(a), len(b)]), [partenum.sketch(a, percent), partenum.sketch(b, percent)], percent)
                assert near(0, np.array([1]))[0]
        assert partenum.shared_counts([a, b])[0, 1] == both


def test_hot_signatures_and_blocks(spark, monkeypatch):
    """Small bounds everywhere: signatures go out at once as hot ones, parts are many, buckets are compared block by block."""
    monkeypatch.setattr(partenum, "HOT_IN_BATCH", 2)
    monkeypatch.setattr(partenum, "SEND_KEYS", 200)
    monkeypatch.setattr(partenum, "PART_KEYS", 500)
    monkeypatch.setattr(partenum, "FIRST_BUCKETS", 1)
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 300, 60)]
    rows = []
    for i in range(60):
        text = list(base)
        for at in rng.integers(0, len(text), rng.integers(0, 5)):
            text[at] = f"new{rng.integers(0, 30)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = partenum.similarity_components(docs, 5, 80, block=8)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == brute(rows, 5, 80)


def test_drop_similar(odd):
    kept = partenum.drop_similar(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 6, 7, 8, 9, 10, 10]


def test_drop_similar_of_repeated_ids(spark):
    """One (id, text) of each component: an id's other text stays, and near copies go whose id is null or the component's own."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(3, one), (5, one + " end"), (5, two), (None, two + " end"), (7, three), (7, three + " end"), (7, "alone and by itself for ever")]
    kept = partenum.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text[0]) for r in kept) == [(3, "x"), (5, "y"), (7, "a"), (7, "z")]


def test_empty(nothing):
    assert partenum.similarity_components(nothing).count() == 0
    assert partenum.drop_similar(nothing).count() == 0


def test_pairs_are_left_to_shared_buckets_only(spark):
    """Two similar sets meet in bucket C alone; each is also in a bucket of its own, below C, whose 32-bit hashes meet."""
    rng = np.random.default_rng(8)
    base = np.sort(rng.integers(0, 1 << 63, 2000).astype(np.uint64))
    near, far = np.sort(np.append(base[1:], np.uint64(7))), np.sort(rng.integers(0, 1 << 63, 2000).astype(np.uint64))
    a, b, c = 212737767034226, 268917531005858, 275327798639125
    rows = [(a, 1, base), (a, 3, far), (b, 2, near), (b, 3, far), (c, 1, base), (c, 2, near), (c, 3, far)]
    members = spark.createDataFrame([(s, n, len(v), bytearray(partenum.sketch(v, 90)), n) for s, n, v in rows], "sig long, node long, n long, sketch binary, comp long")
    found = partenum.doubtful(members.join(partenum.bucket_lists(members), "node"), 90, 1024).collect()
    assert {(r["sig"], r["node"]) for r in found} == {(c, 1), (c, 2)}


def test_packed_signatures_come_back():
    values = np.array([0, 1, 255, 1 << 40, (1 << 48) - 1], np.int64)
    assert partenum.unpacked_signatures(partenum.packed_signatures(values)).tolist() == values.tolist() and len(partenum.packed_signatures(values)) == 30
    assert len(partenum.unpacked_signatures(b"")) == 0
