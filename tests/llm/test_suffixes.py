"""Suffix arrays, common prefixes and removed bytes against plain Python."""

import hashlib

import numpy as np
import pytest

from episodeframe.llm import suffixes as sx


def brute(rows, width=100):
    """Rows (doc, text) in document order; repeated rows are one document."""
    seen, out, done = {}, [], {}
    for doc, text in rows:
        raw = (text or "").encode()
        if (doc, text or "") in done:
            out.append(done[doc, text or ""])
            continue
        lost = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            w = raw[i : i + width]
            if w in seen:
                lost[i : i + width] = b"\1" * width
            else:
                seen[w] = 1
        kept = bytes(c for c, x in zip(raw, lost) if not x)
        spans = sum(1 for i in range(len(lost)) if lost[i] and (not i or not lost[i - 1]))
        out.append((doc, len(raw), sum(lost), spans, hashlib.sha256(kept).hexdigest()))
        done[doc, text or ""] = out[-1]
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(97, 97 + [1, 2, 3, 4, 26, 200][seed] % 150, 900).astype(np.uint8)
    if seed > 2:
        text[500:800] = text[100:400]
    raw = bytes(text)
    sa = sx.suffix_array(text, 100)
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: (raw[i : i + 100], i))
    lcp = sx.common_prefixes(text, sa)
    for i in range(1, len(sa)):
        a, b = raw[sa[i] :], raw[sa[i - 1] :]
        n = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[i] == n


@pytest.mark.parametrize("table", ["odd", "tiny"])
@pytest.mark.parametrize("bits,hot,merge", [(21, 4096, 4 << 20), (13, 1, 1000)])
def test_removed_bytes(table, bits, hot, merge, request, monkeypatch):
    for k, v in (("SHARD_BITS", bits), ("HOT", hot), ("MERGE_BYTES", merge), ("PIECE", 1 << bits)):
        monkeypatch.setattr(sx, k, v)
    docs = request.getfixturevalue(table).repartition(4)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[0])
    assert sorted(map(tuple, sx.drop_repeats(docs).collect())) == brute(rows)


def test_planted_passages(spark, monkeypatch):
    monkeypatch.setattr(sx, "SHARD_BITS", 12)
    rng = np.random.default_rng(8)
    text = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    passages = [text(n) for n in (99, 100, 101, 150, 400)]
    rows = [(i, text(50) + passages[i % 5] + text(int(rng.integers(0, 300))) + passages[rng.integers(0, 5)] * int(rng.integers(0, 3))) for i in range(60)]
    rows += [(60, "ab" * 400), (61, "ab" * 300), (62, "a" * 99), (63, "a" * 100), (64, "a" * 101)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, sx.drop_repeats(docs).collect())) == brute(rows)
    kept = {r.doc_id: r.kept for r in sx.drop_repeats(docs, keep_text=True).collect()}
    assert bytes(kept[64]) == b"" and len(kept[62]) == 99


def test_runs_that_fill_a_piece(spark):
    """A periodic text longer than a piece is one run of PIECE windows and a rest."""
    rows = [(1, "a" * (sx.PIECE + 300)), (2, "b" * 50 + "a" * 150 + "c" * 50), (3, "word " * (sx.PIECE // 5 + 100)), (4, "a" * (sx.PIECE + 99))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, sx.drop_repeats(docs).collect())) == brute(rows)


def test_equal_hashes_of_other_windows_both_stay():
    """Windows with one hash but other bytes are no repeats."""
    text = np.frombuffer(b"a" * 100 + b"b" * 100 + b"a" * 100, np.uint8)
    one = lambda *at: (np.full(len(at), 7, np.uint64), np.array(at))
    (hashes, places), x, y = sx.absorbed(text, one(0), one(100), 100)
    assert sorted(places.tolist()) == [0, 100] and not len(x)
    (hashes, places), x, y = sx.absorbed(text, one(0), one(200), 100)
    assert places.tolist() == [0] and (x.tolist(), y.tolist()) == ([200], [0])


def test_null_ids_and_ties(spark):
    long = "x1y2z3 " * 40
    docs = spark.createDataFrame([(None, long), (1, long), (1, long), (2, None), (2, "other " + long)], "doc_id long, text string")
    found = sorted((str(r.doc_id), r.n_removed) for r in sx.drop_repeats(docs).collect())
    first = next(n for d, n in found if d == "None")
    assert first == len(long) - 7 and [n for d, n in found if d == "1"] == [len(long)] * 2


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeated_rows_in_several_shards(spark, monkeypatch, hot):
    """Rows of one document in other partitions leave its only copy alone, and still lose what an earlier one has."""
    monkeypatch.setattr(sx, "HOT", hot)
    rng = np.random.default_rng(9)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    own, shared = [text(700) for _ in range(4)], text(300)
    rows = [(None, own[0]), (1, own[1] + shared), (2, own[2] + shared + own[2]), (3, own[3])]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows * 3, 3), "doc_id long, text string")
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r))
    assert docs.rdd.getNumPartitions() == 3
    assert order(map(tuple, sx.drop_repeats(docs).collect())) == order([r for r in brute_all(rows) for _ in range(3)])


def brute_all(rows):
    """brute() for a null id ahead of the others."""
    return [(None if r[0] == -1 else r[0], *r[1:]) for r in brute([(-1 if d is None else d, t) for d, t in rows])]


def test_empty(nothing):
    assert sx.drop_repeats(nothing).count() == 0
