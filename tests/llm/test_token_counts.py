"""Counts and scores against the tokenizers library's unigram model and a plain dynamic programme."""

import pytest
from tokenizers import Tokenizer, models

from episodeframe.llm import token_counts as tc

PIECES = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.5), ("ab", -2.5), ("▁a", -2.25), ("aba", -3.0), ("▁ab", -3.5), ("bb", -3.0), ("▁the", -4.0), ("t", -3.0), ("h", -3.0), ("e", -3.0), ("he", -3.5)]


def test_against_library():
    library = Tokenizer(models.Unigram(PIECES, unk_id=0, byte_fallback=False))
    own = tc.Counter(PIECES[1:])
    own.unknown = min(s for _, s in PIECES) - tc.UNKNOWN_PENALTY
    for text in ["a", "ab", "abab", "the ab", "aabb the b", "xyz", "a xx b", "x", "  ab  ", "thethe abba", "abcab"]:
        n = len(library.encode("▁" + text.replace(" ", "▁")).ids)
        assert own.count(text)[0] == n, text


@pytest.fixture(scope="module")
def real():
    vocabulary = tc.vocabulary()
    return vocabulary, Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))


def by_library(real, text):
    """(pieces, score) of the library's segmentation: byte pieces stand for a character no piece covers."""
    vocabulary, library = real
    coded = library.encode("▁" + text.replace(" ", "▁")) if text else None
    score, of = 0.0, dict(reversed([(p, s) for p, s in vocabulary]))
    unknown = min(s for _, s in vocabulary) - tc.UNKNOWN_PENALTY
    seen = set()
    for token, span in zip(coded.tokens, coded.offsets) if coded else ():
        whole = ("▁" + text.replace(" ", "▁"))[span[0] : span[1]]
        if token.startswith("<0x") and whole != token:
            score += unknown * len(whole) if span not in seen else 0.0
            seen.add(span)
        else:
            score += of[token]
    return (len(coded.ids), score) if coded else (0, 0.0)


def test_whole_table_against_library(tiny, real):
    """Every whole text of the table with the real vocabulary: piece count and score."""
    got = {r.doc_id: (r.n_pieces, r.score) for r in tc.token_counts(tiny).collect()}
    for r in tiny.collect():
        n, score = by_library(real, r.text or "")
        assert got[r.doc_id][0] == n, r.doc_id
        assert got[r.doc_id][1] == pytest.approx(score), r.doc_id


def test_odd_texts_against_library(real):
    it = tc.Counter(real[0])
    for text in ["", " ", "  a  b ", "</s> <0x41> <s>", "a</s>b", "naïve 😀😀 x", "▁ mark", "日本 語", "word " * 300, "x" * 400, "a\nb\tc", "\u0378\u0379 z"]:
        assert it.count(text)[0] == by_library(real, text)[0], text


def test_plain_dynamic_programme():
    """Score and count of the best path by trying every piece at every place; ties go to the longest last piece."""
    own = tc.Counter(PIECES[1:])
    pieces = dict(PIECES[1:])

    def plain(text):
        best = {0: (0.0, 0)}
        for end in range(1, len(text) + 1):
            for start in range(end):
                if text[start:end] in pieces and start in best:
                    total = best[start][0] + pieces[text[start:end]]
                    if end not in best or total > best[end][0]:
                        best[end] = total, best[start][1] + 1
        return best[len(text)][1], best[len(text)][0]

    for text in ["▁abab", "▁aabb▁the▁b", "▁thethe▁abba", "▁abcab".replace("c", ""), "▁" + "ab" * 50]:
        assert own.solve(text) == plain(text), text


@pytest.mark.parametrize("table", ["odd", "tiny"])
def test_by_word_equals_whole_text(table, request):
    docs = request.getfixturevalue(table)
    it = tc.Counter(tc.vocabulary())
    assert it.by_word
    got = {(r.doc_id, r.n_pieces, r.score) for r in tc.token_counts(docs).collect()}
    it.by_word = False
    rows = [r for r in docs.collect() if len(r.text or "") < 4000]
    assert {(r.doc_id, *it.count(r.text or "")) for r in rows} <= got


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tc, "MEMO_BYTES", 1000)
    it = tc.Counter(tc.vocabulary())
    for i in range(100):
        it.count(f"word{i} and " + "y" * (100 + i))
    assert len(it.memo) < 30 and not any(len(p) > tc.LONGEST for p in it.memo)


def test_empty(nothing):
    assert tc.token_counts(nothing).count() == 0
