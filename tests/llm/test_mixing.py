"""The mix against a plain loop over documents."""

import re

import pytest

from episodeframe.llm import mixing
from episodeframe.llm.common import word_count


def sizes(rows):
    return [len(re.findall("[^\x20\x09-\x0d]+", r.text or "")) for r in rows]


def targets(rows, weights=(1, 2, 3), cap=3.0):
    """Targets by repeated resharing of what the capped sources leave."""
    size = {}
    for r, n in zip(rows, sizes(rows)):
        size[r.source] = size.get(r.source, 0) + n
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        left = sum(size.values()) - sum(fixed.values())
        share = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = {s: cap * size[s] for s in free if share[s] > cap * size[s] + 1e-9}
        if not over:
            return size, fixed | share
        fixed |= over


@pytest.mark.parametrize("table", ["odd", "tiny"])
def test_targets_and_budgets(table, request):
    docs = request.getfixturevalue(table)
    rows = docs.collect()
    size, target = targets(rows)
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    assert sorted(r.size for r in found) == sorted(sizes(rows))
    taken = {}
    for r in found:
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1 if len({(r.doc_id, r.text) for r in rows if r.source == s}) else True


def test_reruns_agree_and_order_does_not_matter(tiny):
    first = {r.doc_id: r.taken for r in mixing.mix(tiny).collect()}
    again = {r.doc_id: r.taken for r in mixing.mix(tiny.repartition(5)).collect()}
    assert first == again


def test_mixed_documents_keep_columns(odd, tiny):
    assert mixing.mixed_documents(odd).columns == odd.columns
    out = mixing.mixed_documents(tiny)
    assert out.columns == tiny.columns
    size, target = targets(tiny.collect())
    words = {r.source: r.n for r in out.groupBy("source").agg({"doc_id": "count"}).withColumnRenamed("count(doc_id)", "n").collect()}
    assert set(words) <= set(size)
    total = sum(sizes(out.collect()))
    assert abs(total - sum(target.values())) < 0.05 * total


def test_mixed_documents_of_repeated_rows(spark):
    """Repeated rows come out as often as the mix takes them together, though the budget ends among them."""
    rows = [(1, "one two three four", s) for s in "ab" for _ in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    share = mixing.mix(docs).collect()
    want = {s: sum(r.copies + (2 * (r.taken - r.copies * r.size) >= r.size) for r in share if r.source == s) for s in "ab"}
    assert any(n % 10 for n in want.values())
    out = mixing.mixed_documents(docs).collect()
    assert {s: sum(r.source == s for r in out) for s in "ab"} == want


def test_empty(nothing):
    assert mixing.mix(nothing).count() == 0
    assert mixing.mixed_documents(nothing).count() == 0


def test_word_count(spark):
    texts = ["", None, " a ", "a\x0bb\x0cc\rd", "a b", "\x1c x", "é\n\n\nö"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(word_count(df.text)).collect()] == [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for t in texts]
