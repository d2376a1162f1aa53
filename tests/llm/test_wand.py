"""Ranked search against scoring every document, blocks against all ways to cut a list."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from episodeframe.llm import wand

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(bag.values()) for _, bag in bags]
    many, total = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, bag in bags for t in bag)
    out = []
    for name, text in items:
        found = []
        for (i, bag), n in zip(bags, sizes, strict=True):
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * (10 + 90 * n * many // total))) for t in set(terms(text)) if bag[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(name, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def frames(spark, docs, items):
    d = spark.createDataFrame([(*r, "x", 1, 2) for r in docs], "doc_id long, text string, terms string, n int, score int")
    return d, spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, rank string")


def check(spark, docs, items, k=10):
    got = wand.ranked(*frames(spark, docs, items), k=k)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, k)


@pytest.mark.parametrize("seed,limit", [(0, 1 << 21), (1, 300), (2, 40)])
def test_random_texts(spark, seed, limit, monkeypatch):
    """Frequent and rare words, copies (ties), shards of all sizes."""
    monkeypatch.setattr(wand, "SHARD_POSTINGS", limit)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ñandú", "日本", "7"]
    text = lambda n: " ".join(vocabulary[min(62, int(rng.expovariate(0.08)))] for _ in range(n))
    docs = [(i, text(rng.choice([1, 5, 30, 200]))) for i in range(250)]
    docs += [(1000 + i, docs[i % 9][1]) for i in range(60)] + [(5, docs[5][1]), (None, docs[6][1]), (None, None), (2000, ""), (2001, "...;")]
    rng.shuffle(docs)
    check(spark, docs, [(i, text(rng.choice([1, 3, 12]))) for i in range(30)] + [(1, docs[3][1]), (None, "W1 w1 日本"), (90, None), (91, "!"), (92, "unheard")], 7)


def test_long_and_equal_texts(spark):
    docs = [(i, "same text here") for i in range(40)] + [(50, "Same " * 100_000), (51, "here")]
    check(spark, docs, [(1, "same"), (2, "here, HERE!"), (3, "text same here")])


def test_empty_tables(spark):
    docs, items = [(1, "a b"), (2, None)], [(1, "a")]
    d, i = frames(spark, docs, items)
    assert wand.ranked(d.where("false"), i).collect() == [] == wand.ranked(d, i.where("false")).collect() == wand.ranked(d.where("text is null"), i).collect()


def test_groups_of_queries(spark, monkeypatch):
    monkeypatch.setattr(wand, "QUERY_TERMS", 4)
    docs = [(i, " ".join(f"w{(i * j) % 7}" for j in range(1 + i % 5))) for i in range(50)]
    check(spark, docs, [(i, f"w{i % 7} w{i % 3}") for i in range(9)])


def cost(values, firsts):
    ends = [*firsts[1:], len(values)]
    return sum((z - a) * max(values[a:z]) for a, z in zip(firsts, ends, strict=True)) + wand.BLOCK_COST * max(values) * len(firsts)


def test_blocks_are_the_best():
    """Of all ways to cut a list; longer lists against the plain recurrence."""
    rng = random.Random(4)
    for _ in range(30):
        values = [rng.choice([1, 2, 3, 50, 51, 90]) for _ in range(rng.randint(1, 11))]
        got = np.flatnonzero(wand.cut(np.array([values], float), np.array([len(values)]))[0]).tolist()
        ways = [[0, *(i for i in range(1, len(values)) if m >> i & 1)] for m in range(0, 1 << len(values), 2)] if len(values) > 1 else [[0]]
        assert got[0] == 0 and cost(values, got) == min(cost(values, w) for w in ways)
    lists = [[rng.randint(1, 1000) for _ in range(n)] for n in (1, 63, 64, 65, 300)]
    width = max(map(len, lists))
    marks = wand.cut(np.array([v + [v[-1]] * (width - len(v)) for v in lists], float), np.array([len(v) for v in lists]))
    for values, row in zip(lists, marks, strict=True):
        best = [0.0]
        for j in range(1, len(values) + 1):
            best.append(min(best[i] + (j - i) * max(values[i:j]) + wand.BLOCK_COST * max(values) for i in range(max(0, j - wand.BLOCK), j)))
        firsts = np.flatnonzero(row).tolist()
        assert cost(values, firsts) == best[-1] and max(np.diff([*firsts, len(values)])) <= wand.BLOCK


def test_reading_skips_blocks():
    """A shard of lists with few high impacts: the best come out, and most postings are never read."""
    rng = np.random.default_rng(9)
    n = 20_000
    counts = np.where(rng.random(2 * n) < 0.002, 50, 1)
    shard = wand.Shard(np.arange(n), np.zeros(n, bool), np.full(n, 1000), np.full(n, 2), np.tile([0, 1], n), counts, np.array([700, 900]), 8)
    doc, score = shard.best(np.array([0, 1]), 10)
    every = shard.impacts[:n] + shard.impacts[n:]
    want = np.lexsort((np.arange(n), -every))[:10]
    assert doc.tolist() == want.tolist() and score.tolist() == every[want].tolist()
    assert shard.read < 0.1 * 2 * n
