"""Benchmark decontamination against a plain search for every window."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from episodeframe.llm import decontamination, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    """id -> (n_words, n_hit, names) by looking every window up in a table of windows."""
    table = {}
    for name, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            table.setdefault(tuple(w[i : i + size]), set()).add("null" if name is None else str(name))
    sizes = {len(k) for k in table}
    out = []
    for name, text in docs:
        w, hit, names = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if found := table.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    names |= found
        out.append((name, len(w), len(hit), sorted(names)))
    return out


def key(row):
    return str(row[0]), *row[1:]


def check(spark, docs, items, window=10):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, items string, n_hit int")
    i = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, spans string")
    got = decontamination.contamination(d, i, window).collect()
    want = brute(docs, items, window)
    assert sorted((key((r["doc_id"], r["n_words"], r["n_hit"], r["items"])) for r in got)) == sorted(map(key, want))
    for r in got:
        assert sum(s["last"] - s["first"] for s in r["spans"]) == r["n_hit"] and r["n_items"] == len(r["items"]) and r["contaminated"] == (r["n_hit"] > 0)
        assert all(a["last"] < b["first"] for a, b in zip(r["spans"], r["spans"][1:]))
    return got


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    """Few words, so windows overlap, repeat and start over at every turn; short items are suffixes of others."""
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c9", "ñ", "DÉJÀ", "f"][: 3 + seed]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 3, 4, 5, 6, 7, 9, 15]))) for i in range(25)] + [(3, text(6)), (None, text(5)), (40, None)]
    check(spark, [(i, text(rng.choice([0, 2, 5, 30, 60]))) for i in range(60)] + [(1, text(20)), (None, text(20)), (99, None)], items, 6)


def test_cases(spark):
    ten = "One two three four five six seven eight nine ten"
    items = [(1, ten + " eleven"), (2, ten), (3, "unique"), (4, "  ...  "), (12, "nine-ten?")]
    docs = [(1, ten), (2, ten.replace(" ", " ")), (3, "x " + ten.upper() + " ELEVEN y"), (4, "one two three four five six seven eight nine"), (5, "a Unique a"), (6, "..."), (7, ""), (8, "nine ten " * 40000), (9, "It's NINE_TEN")]
    got = {r["doc_id"]: r for r in check(spark, docs, items)}
    assert got[1]["items"] == ["1", "12", "2"] and got[3]["n_hit"] == 11 and got[2]["n_hit"] == 0 and got[4]["n_hit"] == 0 and got[5]["n_hit"] == 1
    assert got[8]["n_hit"] == 80000 and len(got[8]["spans"]) == 1 and got[9]["n_hit"] == 2


def test_removal(spark, odd):
    items = spark.createDataFrame([(1, "sat on the mat and then the cat sat on"), (2, "naïve café")], "item_id long, text string")
    kept = decontamination.decontaminated(odd, items, coverage=0.6)
    assert kept.schema == odd.schema
    got, before = kept.collect(), odd.collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in before if r["doc_id"] not in (1, 4, 11))
    text = {r["doc_id"]: r["text"] for r in got}
    assert text[6] == " 😀 ▁ mark  double  blanks" and text[2] is None and text[8] == "word " * 3000
    every = {r["doc_id"]: r["text"] for r in decontamination.decontaminated(odd, items, coverage=1.0).collect()}
    assert every[1] == "the cat  the mat again"
    assert {r["doc_id"] for r in decontamination.decontaminated(odd, items, coverage=0.0).collect()} == {2, 3, 5, 7, 8, 9, 10}


def test_empty_tables_and_bound(spark, odd, nothing, monkeypatch):
    items = spark.createDataFrame([(1, "the cat")], "item_id long, text string")
    assert decontamination.contamination(nothing, items).collect() == []
    assert {r["n_hit"] for r in decontamination.contamination(odd, items.where("false")).collect()} == {0}
    monkeypatch.setattr(decontamination, "MAX_WORDS", 1)
    with pytest.raises(ValueError, match="2 words"):
        decontamination.automaton(items)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = queries.op13_benchmark_decontamination(spark, sf).collect()
    want = [(i, n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0) for i, n, hit, names in brute(docs, items)]
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == sorted(want)
    assert any(w[5] for w in want)
