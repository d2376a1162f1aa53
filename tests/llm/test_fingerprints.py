"""Fingerprints against a plain LZ78 parse; neighbours against a loop."""

import hashlib

import pytest

from episodeframe.llm import fingerprints as fp


def phrases(text):
    seen, at = {}, 0
    for i in range(len(text)):
        if text[at : i + 1] not in seen:
            seen[text[at : i + 1]] = 1
            at = i + 1
    return list(seen)


def test_phrases_cover_distinct_parts():
    for text in ("", "a", "aaaaaa", "abababab", "naïve café 😀"):
        lengths = fp.phrase_lengths(text)
        assert [len(p) for p in phrases(text)] == lengths.tolist()


@pytest.mark.parametrize("table", ["odd", "tiny"])
def test_neighbours(table, request):
    docs = request.getfixturevalue(table)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()))
    want = []
    for i, (doc, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        edit = fp.edited_text(text, following)
        a, b, c = (fp.fingerprint(t) for t in (text, edit, following))
        want.append((doc, len(text), hashlib.sha256(edit.encode()).hexdigest(), fp.to_hex(a), fp.to_hex(b), fp.likeness(a, b), fp.likeness(a, c)))
    found = sorted(map(tuple, fp.neighbours(docs).collect()))
    assert found == sorted(want)


def test_likeness_follows_similarity():
    base = " ".join(f"word{i * 7919 % 1000}" for i in range(800))
    near, far = base.replace("word7", "term7"), " ".join(f"x{i * i % 997}" for i in range(800))
    one, two, three = (fp.fingerprint(t) for t in (base, near, far))
    assert fp.likeness(one, one) == 1.0 > fp.likeness(one, two) > fp.likeness(one, three)


def test_equal_texts_agree_and_columns_stay(odd):
    found = fp.fingerprints(odd)
    assert found.columns == [*odd.columns, "fingerprint"]
    by = {r.doc_id: r.fingerprint for r in found.collect()}
    assert by[1] == by[4] and by[2] == by[3] == ""


def test_empty(nothing):
    assert fp.neighbours(nothing).count() == 0
    assert fp.fingerprints(nothing).count() == 0


def test_likeness_estimates_the_true_jaccard():
    """Against the phrase sets themselves, for texts that share more or less: within three standard errors of 128 hashes."""
    import random

    rng = random.Random(4)
    base = [f"w{rng.randrange(4000)}" for _ in range(3000)]
    for share in (0.0, 0.1, 0.3, 0.6, 0.9):
        other = [w if i < share * len(base) else f"v{rng.randrange(4000)}" for i, w in enumerate(base)]
        one, two = (" ".join(t) for t in (base, other))
        a, b = set(phrases(one)), set(phrases(two))
        true = len(a & b) / len(a | b)
        assert abs(fp.likeness(fp.fingerprint(one), fp.fingerprint(two)) - true) < 3 * (true * (1 - true) / fp.KEEP) ** 0.5 + 0.01
    assert fp.fingerprint("abab").tolist() == sorted(fp.fingerprint("abab").tolist()) and len(fp.fingerprint("abab")) == len(set(phrases("abab")))


def test_own_fingerprint_column_is_replaced(odd):
    again = fp.fingerprints(fp.fingerprints(odd))
    assert again.columns == [*odd.columns, "fingerprint"] and again.count() == odd.count()
