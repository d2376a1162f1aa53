"""Each stage of the pipeline against a loop over its own input, and all of them on odd and empty tables."""

import hashlib
from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
from episodeframe.llm import mixing, quality, sentencepieces

from .test_mixing import sizes
from .test_partenum import shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with copies, near copies, repeated rows, null texts and ids, and columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    d = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 6000")
    extra = d.where("doc_id % 11 = 0")
    odd = extra.withColumn("doc_id", F.col("doc_id") + 100000).unionByName(extra).unionByName(extra.withColumn("text", F.lit(None).cast("string")))
    near = d.where("doc_id % 7 = 0").withColumns({"doc_id": F.col("doc_id") + 200000, "text": F.concat("text", F.lit(" end"))})
    none = d.where("doc_id % 13 = 0").withColumns({"doc_id": F.lit(None).cast("long"), "text": F.concat("text", F.lit(" none"))})
    every = d.unionByName(odd).unionByName(near).unionByName(none)
    return every.withColumns({c: F.lit(1) for c in ("_id", "node", "bucket", "copy", "kept", "_gone", "features")}).cache()


def rows(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def test_classify_keeps_what_the_model_passes(spark, docs):
    kept = corpus_pipeline.classify(spark, docs, SF)
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {(r.doc_id, r.p_top >= 0.5) for r in quality.graded(docs, model).collect()}
    assert kept.columns == docs.columns
    assert {i for i, _ in ((r.doc_id, 1) for r in kept.collect())} <= {i for i, ok in good if ok}
    assert sum(rows(kept).values()) == quality.graded(docs, model).where("p_top >= 0.5").count()


def test_dedup_keeps_the_largest_id_of_each_text(spark, docs):
    kept = corpus_pipeline.dedup(spark, docs, SF)
    last = {}
    for r in docs.collect():
        t = r.text or ""
        if r.doc_id is not None:
            last[t] = max(last.get(t, -1), r.doc_id)
    want = Counter((r.doc_id, r.text, r.source) for r in docs.collect() if last.get(r.text or "") == r.doc_id)
    assert kept.columns == docs.columns and rows(kept) == want


def test_near_dedup_keeps_one_of_each_component(spark, docs):
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    all_ = [(r.doc_id, r.text) for r in docs.collect()]
    texts = sorted({t for _, t in all_ if t and t.split()})
    sets = [shingles(t, 5) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for pair in {(i, j) for group in by.values() for i in group for j in group if i < j}:
        i, j = pair
        both = len(sets[i] & sets[j])
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    at = {t: find(i) for i, t in enumerate(texts)}
    found = [(r.doc_id, r.text) for r in kept.collect()]
    # documents without words all stay; of each component rows of one (id, text) stay, with the smallest id
    assert Counter(x for x in found if x[1] not in at) == Counter(x for x in all_ if x[1] not in at)
    stay = {}
    for d, t in found:
        if t in at:
            stay.setdefault(at[t], set()).add((d, t))
    least = {}
    for d, t in all_:
        if t in at:
            key = (d is None, d or 0)
            least[at[t]] = min(least.get(at[t], key), key)
    assert set(stay) == set(least) and all(len(s) == 1 for s in stay.values())
    assert all((d is None, d or 0) == least[c] for c, s in stay.items() for d, _ in s)


def test_mixture_takes_rows_as_often_as_the_mix_says(spark, docs):
    out = corpus_pipeline.mixture(spark, docs, SF)
    share = mixing.mix(docs).collect()
    times = Counter()
    for r in share:
        if r.size:  # documents without words are left out
            times[r.source] += r.copies + (2 * (r.taken - r.copies * r.size) >= r.size)
    assert out.columns == docs.columns
    assert Counter(r.source for r in out.collect()) == +times
    assert all(n > 0 for n in sizes(out.collect()))


def test_tokenise_is_the_library(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_eos=True)
        want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.tokenise(spark, docs, SF).collect()) == want


def test_stages_in_turn(spark):
    """run() is the stages one after another; only documents that all of them keep come out, and reruns agree."""
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert sorted(rows) == sorted(corpus_pipeline.run(spark, SF).collect())
    ids = {r.doc_id for r in rows}
    assert out.columns[:2] == ["doc_id", "n_tokens"] and ids <= {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["classify", "exact_dedup", "near_dedup", "mix", "tokenise"]


def test_odd_and_empty_tables(spark, odd, nothing):
    """Each stage on rows with nulls, repeats, ties and clashing columns: what comes out are rows that went in, and which ones."""
    rows, keys = odd.collect(), lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    whole = keys(odd)
    assert keys(corpus_pipeline.classify(spark, odd, SF)) <= whole
    # the empty texts are one group, of which id 3 stays; of 1 and 4 the larger id; the repeated row stays twice
    assert keys(corpus_pipeline.dedup(spark, odd, SF)) == Counter((r.doc_id, r.text) for r in rows if r.doc_id not in (1, 2))
    # 11 differs from 1 and 4 in case alone
    assert keys(corpus_pipeline.near_dedup(spark, odd, SF)) == Counter((r.doc_id, r.text) for r in rows if r.doc_id not in (4, 11))
    mixed = corpus_pipeline.mixture(spark, odd, SF)
    assert set(keys(mixed)) <= set(whole) and all(r.text for r in mixed.collect()) and mixed.columns == odd.columns
    assert Counter(r.doc_id for r in corpus_pipeline.tokenise(spark, odd, SF).collect()) == Counter(r.doc_id for r in rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0
