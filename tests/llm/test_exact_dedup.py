"""Exact dedup against grouping in a dictionary."""

import hashlib

import pytest

from episodeframe.llm import common, exact_dedup


@pytest.mark.parametrize("table", ["odd", "tiny"])
@pytest.mark.parametrize("limit", [common.BROADCAST_ROWS, 0])
def test_drop_keeps_one(table, limit, request, monkeypatch):
    """Whether keys are broadcast or shuffled, the row with the largest id of each text stays."""
    monkeypatch.setattr(exact_dedup, "small", lambda df: common.small(df, limit_rows=limit))
    docs = request.getfixturevalue(table)
    rows, last = docs.collect(), {}
    for r in rows:
        last[r.text or ""] = max(last.get(r.text or "", r.doc_id), r.doc_id)
    want = sorted((r.doc_id, r.text or "") for r in rows if last[r.text or ""] == r.doc_id)
    assert sorted((r.doc_id, r.text or "") for r in exact_dedup.drop_copies(docs).collect()) == want


def test_groups_come_from_what_the_levels_leave(spark, monkeypatch):
    """Only rows that length and prefix hash leave reach the grouping by full hash."""
    seen = []
    plain = exact_dedup.grouped
    monkeypatch.setattr(exact_dedup, "grouped", lambda alive: (seen.append(alive.count()), plain(alive))[1])
    rows = [(1, "same"), (2, "same"), (3, "other"), (4, "ether"), (5, "alone by its length"), (6, None), (7, ""), (8, "x" * 300 + "a"), (9, "x" * 300 + "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert exact_dedup.exact_copies(docs).where("group_size > 1").count() == 4
    assert exact_dedup.drop_copies(docs).count() == 7
    assert seen == [6, 6]  # 1, 2, 6, 7 and the pair that differs behind the prefix


@pytest.mark.parametrize("table", ["odd", "tiny"])
@pytest.mark.parametrize("limit", [common.BROADCAST_ROWS, 0])
def test_groups(table, limit, request, monkeypatch):
    monkeypatch.setattr(exact_dedup, "small", lambda df: common.small(df, limit_rows=limit))
    docs = request.getfixturevalue(table)
    rows = docs.collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.text or "", []).append(r.doc_id)
    want = sorted((r.doc_id, max(g), len(g), max(g) == r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows for g in [groups[r.text or ""]])
    assert sorted(map(tuple, exact_dedup.exact_copies(docs).collect())) == want


def test_drop_copies(odd):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7, 8, 9, 10, 10, 11]


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    found = sorted((tuple(r)[:4] for r in exact_dedup.exact_copies(docs).collect()), key=str)
    assert found == sorted([(None, 1, 3, False), (None, 1, 3, False), (1, 1, 3, True), (None, None, 1, True)], key=str)


def test_drop_copies_of_repeated_ids(spark):
    docs = spark.createDataFrame([(5, "A"), (5, "B"), (9, "A"), (None, "A"), (None, "C")], "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.drop_copies(docs).collect()), key=str) == [(5, "B"), (9, "A"), (None, "C")]


def test_empty(nothing):
    assert exact_dedup.exact_copies(nothing).count() == 0
    assert exact_dedup.drop_copies(nothing).count() == 0


def test_native(odd):
    plan = exact_dedup.exact_copies(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
