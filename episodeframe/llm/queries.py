"""The registered query of each training-data operator, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, fingerprints, interpolation, mixing, partenum, quality, sentencepieces, suffixes, token_counts, token_store, wand, whitening
from .common import documents


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness."""
    return fingerprints.neighbours(documents(spark, sf_dir))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probabilities and the decision for every document."""
    docs = documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = quality.graded(docs, model)
    return found.withColumn("kept", found["p_top"] >= 0.5)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, survivor and digest of every document."""
    return exact_dedup.exact_copies(documents(spark, sf_dir))


def op5_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log-probabilities of every text."""
    return interpolation.lm_scores(documents(spark, sf_dir))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and CRC of every document's ids, read back from a store in the shared folder."""
    return token_store.store_digests(documents(spark, sf_dir))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of what they decode to."""
    return sentencepieces.digests(documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every text that an earlier 100-byte string repeats, and the digest of the rest."""
    return suffixes.drop_repeats(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram piece count and best score of every text."""
    return token_counts.token_counts(documents(spark, sf_dir))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of Jaccard 0.9 on three-word shingles."""
    return partenum.similarity_components(documents(spark, sf_dir), k=3, percent=90).drop("node")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the leading components of the fit list, with unit variance."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return wand.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document the benchmark's windows hit, and whose windows they are."""
    found = decontamination.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items", "spans")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_lz_fingerprints, op3_quality_classifier, op4_exact_dedup, op5_deleted_interpolation, op6_token_store, op7_sentencepiece, op8_suffix_dedup, op9_token_counts, op10_jaccard_join, op11_embedding_whitening, op12_ranked_search, op13_benchmark_decontamination, pipeline)}

ORACLE_SQL = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op12_ranked_search": r"""
        WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
             q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
             sizes AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
             totals AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM sizes),
             tfs AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
             weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term),
             scored AS (
                 SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nn) // l))))) AS BIGINT) AS score
                 FROM q JOIN tfs USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 10
    """,
    "op13_benchmark_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
             b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
             bi AS (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
             windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM bi),
             di AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size),
             hits AS (SELECT doc_id, i, di.size, item_id FROM di JOIN windows ON di.size = windows.size AND array_to_string(w[i:i + di.size - 1], ' ') = g),
             places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
             names AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN places USING (doc_id) LEFT JOIN names USING (doc_id)
    """,
}
