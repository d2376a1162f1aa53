"""Ids and texts equal the sentencepiece library's; spans tile the source."""

import hashlib

import pytest
import sentencepiece

from episodeframe.llm import sentencepieces as sp


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sp.default_model())


@pytest.mark.parametrize("table", ["odd", "tiny"])
def test_digests(table, request, library):
    docs = request.getfixturevalue(table)
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_eos=True)
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(tuple(r)[:4] for r in sp.digests(docs).collect()) == sorted(want)


@pytest.mark.parametrize("table", ["odd", "tiny"])
def test_spans(table, request, library):
    docs = request.getfixturevalue(table)
    coded = sp.encode_documents(docs)
    assert set(docs.columns) - {"ids"} <= set(coded.columns)
    for r in coded.collect():
        raw, shown = (r.text or "").encode(), library.encode(r.text or "", return_type="proto")
        assert len(r.ids) == len(shown.pieces) + 1
        assert [(b, e) for b, e in zip(r.begins, r.ends)][:-1] == byte_spans(r.text or "", shown)
        assert r.begins[-1] == r.ends[-1] == len(raw)


def byte_spans(text, shown):
    """The library's own byte spans, with byte pieces of one character parted."""
    out = [(p.begin, p.end) for p in shown.pieces]
    # byte pieces of one character: the library gives the whole character to the last of them
    fixed, i = [], 0
    while i < len(out):
        j = i
        while j < len(out) and shown.pieces[j].piece.startswith("<0x") and len(shown.pieces[j].piece) == 6 and out[j][0] == out[j][1]:
            j += 1
        if j > i and j < len(out) and shown.pieces[j].piece.startswith("<0x"):
            begin = out[j][0]
            fixed += [(begin + k, begin + k + 1) for k in range(j - i + 1)]
            i = j + 1
        else:
            fixed.append(out[i])
            i += 1
    return fixed


@pytest.fixture(scope="module")
def mapped(tmp_path_factory):
    """The public model with the library's own compiled character map and blank rules put in: nothing is trained."""
    normaliser = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    spec = next(v for n, v in sp.fields(normaliser.serialized_model_proto()) if n == 3)

    def message(number, blob):
        size, out = len(blob), bytes([number << 3 | 2])
        while size > 127:
            out, size = out + bytes([size & 127 | 128]), size >> 7
        return out + bytes([size]) + blob

    raw = open(sp.default_model(), "rb").read()
    kept = b"".join(message(n, v) for n, v in sp.fields(raw) if n in (1, 2))
    path = str(tmp_path_factory.mktemp("model") / "mapped.model")
    open(path, "wb").write(kept + message(3, spec))
    return path, sp.Encoder(path)


MAPPED = ["", " ", "ｈｅｌｌｏ ﬁne", "Ⅳ é ① ㎏", "  two  blanks ", "a\tb\nc", "ｶﾞｷﾞ ｱ", "e\u0301 \u1e9b\u0323 x", "\u200b zero \ufeff", "naïve café 😀 ½", "①②③ …", "\u3000wide\u3000", "ﷺ", "a" * 50 + "ﬀ" * 20]


def test_character_map_as_the_library(mapped):
    """Normalisation by longest prefix through the compiled map: bytes, ids and byte spans are the library's."""
    path, it = mapped
    assert it.map and it.squeeze
    normaliser = sentencepiece.SentencePieceNormalizer(model_file=path)
    for text in MAPPED:
        made, align = it.normalise(text)
        assert made.decode() == normaliser.Normalize(text), text
        shown = it.library.encode(text, return_type="proto")
        ids = it.encode([text])[0]
        begins, ends = it.spans(text, ids)
        assert ids[:-1] == [p.id for p in shown.pieces], text
        # bytes of a replaced character have no source bytes of their own: as in the library, the last has them all
        told = [(p.begin, p.end) for p in shown.pieces]
        for k, span in enumerate(zip(begins.tolist()[:-1], ends.tolist()[:-1], strict=True)):
            assert span in (told[k], byte_spans(text, shown)[k]), (text, k)


def test_mapped_documents(spark, mapped, odd):
    path, it = mapped
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(MAPPED)] + [(99, None)], "doc_id long, text string")
    for r in sp.digests(docs, model=path).collect():
        ids = it.library.encode(([*MAPPED, *[None] * 100][r.doc_id]) or "", add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(it.library.decode(ids).encode()).hexdigest()
    assert sp.digests(odd, model=path).count() == odd.count()


def test_pieces_that_do_not_tile_are_an_error():
    it = sp.Encoder(sp.default_model())
    with pytest.raises(ValueError, match="pieces"):
        it.spans("some text", it.encode(["another text"])[0])


def test_decode(odd, library):
    coded = sp.encode_documents(odd, out="t_")
    back = sp.decode_documents(coded, "t_ids", "again")
    for r in back.collect():
        assert r.again == library.decode(library.encode(r.text or ""))


def test_empty(nothing):
    assert sp.digests(nothing).count() == sp.encode_documents(nothing).count() == 0
