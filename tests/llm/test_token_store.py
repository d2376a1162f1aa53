"""The store's ids equal the tokenizers library's, its files reconstruct them, and damage is seen."""

import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from episodeframe.llm import token_store as ts
from episodeframe.llm.common import new_path


def wanted(rows):
    library = Tokenizer.from_file(ts.default_tokenizer())
    return [[*library.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows]


@pytest.mark.parametrize("table", ["odd", "tiny"])
def test_digests(table, request):
    docs = request.getfixturevalue(table)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[0])
    start, want = 0, []
    for (doc, _), ids in zip(rows, wanted(rows)):
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = ts.store_digests(docs)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found.collect()) == want


def test_reconstruct_and_manifest(spark, tiny):
    path = new_path(spark, "test-store")
    ts.write_store(tiny, path)
    assert ts.check_manifest(spark, path)
    rows = sorted((r.doc_id, r.text) for r in tiny.collect())
    assert [r.ids for r in ts.read_documents(spark, path).orderBy("start").collect()] == wanted(rows)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("address").distinct().count()


ODD = ["a  b", " a", "a ", "a\nb", "a \n b", "a\n\nb.", "it's we'll  'tis", "x.\n\ty", "tab\there", "é ü. 12,5% (a) b!?", " a  b", "a　 b", "\n", "don't. 'll", "日本 語。 x", "a.b! c?d", "word.'s it.'d", "\x1c a \x85b", "", "a\x00b \x1f.", "x" * 40 + " y1z", "one <|endoftext|> two", "<|endoftext|>", "a\u2028 b\xa0c é\u2003.d"]


def encoded(texts):
    it = ts.PieceEncoder(ts.default_tokenizer())
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(t) for t in raw])
    ids, stops = it.encode(np.frombuffer(b"".join(raw), np.uint8), offsets, 0)
    return it, [x.tolist()[:-1] for x in np.split(ids, stops[:-1])] if texts else []


def test_pieces_as_the_library():
    rng = np.random.default_rng(8)
    signs = list("ab1. ,'\n\t  \xa0é日\x1c-") + ["'s", "  ", "<|endoftext|>", "word"]
    texts = ODD + ["".join(rng.choice(signs, rng.integers(1, 24))) for _ in range(3000)]
    it, found = encoded(texts)
    for t, ids in zip(texts, found, strict=True):
        assert ids == it.library.encode(t, add_special_tokens=False).ids, t


def test_special_strings_are_the_librarys():
    """A text that holds an added token's string gets its id, as a plain library call gives it."""
    assert 50256 in encoded(["one <|endoftext|> two"])[1][0]


def test_plain_pieces_skip_the_pre_tokenizer():
    """Pieces of one class need no cutting, and others without blanks are one text, not one each."""
    texts = ["Some wörds, 12 of Straße×9!", "Œuvre ÿ÷ĀƀɎ", "x<|> 7"]
    want = [Tokenizer.from_file(ts.default_tokenizer()).encode(t, add_special_tokens=False).ids for t in texts]
    it = ts.PieceEncoder(ts.default_tokenizer())
    asked, library = [], it.library
    it.library = type("Counted", (), {"encode_batch_fast": staticmethod(lambda x, **more: asked.extend(x) or library.encode_batch_fast(x, **more))})
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(t) for t in raw])
    ids, stops = it.encode(np.frombuffer(b"".join(raw), np.uint8), offsets, 0)
    assert [x.tolist()[:-1] for x in np.split(ids, stops[:-1])] == want
    assert len(asked) == 1 and "ö" not in asked[0] and "Straße×" in asked[0]


def test_letters_and_alphabet_are_the_librarys():
    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    for c in map(chr, range(0x240)):
        raw = np.frombuffer(c.encode(), np.uint8)
        if ord(c) >= 0xC0:
            assert (ts.byte_kinds(raw) == ts.LETTER).all() == unicodedata.category(c).startswith("L"), c
        if c != "\n":
            assert level.pre_tokenize_str(c)[0][0] == "".join(map(chr, ts.ALPHABET[raw]))


def test_wide_ids(spark, tiny):
    """Chunks with an id beyond 16 bits stand beside others."""
    path = new_path(spark, "test-store")
    ts.write_store(tiny, path, end=70000)
    rows = sorted((r.doc_id, r.text) for r in tiny.collect())
    want = [(doc, zlib.crc32(np.array([*ids[:-1], 70000], "<u4").tobytes())) for (doc, _), ids in zip(rows, wanted(rows), strict=True)]
    assert sorted((r.doc_id, r.ids_crc32) for r in ts.read_digests(spark, path).collect()) == want


def test_missing_chunk_and_wrong_manifest(spark, tiny):
    path = new_path(spark, "test-store")
    ts.write_store(tiny, path)
    lost = new_path(spark, "test-store")
    for name in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{name}").write.parquet(f"{lost}/{name}")
    one = spark.read.parquet(f"{path}/chunks").orderBy("address").first().address
    spark.read.parquet(f"{path}/chunks").where(F.col("address") != F.lit(one)).write.parquet(f"{lost}/chunks")
    with pytest.raises(Exception, match="missing"):
        ts.read_digests(spark, lost).collect()
    wrong = new_path(spark, "test-store")
    spark.read.parquet(f"{path}/recipes").where("doc_id > 3").write.parquet(f"{wrong}/recipes")
    for name in ("chunks", "manifest"):
        spark.read.parquet(f"{path}/{name}").write.parquet(f"{wrong}/{name}")
    with pytest.raises(ValueError, match="manifest"):
        ts.read_digests(spark, wrong)


def test_cuts_follow_content():
    rng = np.random.default_rng(2)
    run = rng.integers(0, 50000, 20000).astype("<u4")
    other = np.concatenate((rng.integers(0, 50000, 777).astype("<u4"), run))
    parts = lambda ids: {ids[a:b].tobytes() for a, b in zip([0, *ts.cut_points(ids)[:-1]], ts.cut_points(ids))}
    assert len(parts(run) & parts(other)) > 0.8 * len(parts(run))
    assert max(np.diff([0, *ts.cut_points(run)])) <= ts.MOST


def test_empty(spark, nothing):
    path = new_path(spark, "test-store")
    ts.write_store(nothing, path)
    assert ts.read_digests(spark, path).count() == 0 and ts.check_manifest(spark, path)
