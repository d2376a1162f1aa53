"""LM scoring by deleted interpolation: bigram, unigram and uniform estimates mixed by context frequency.

Counts travel, texts do not. The corpus is tokenised once into batches of a few megabytes, each with
its own table of distinct words. A batch sends its distinct keys (word hashes, bigram hashes) with
their training counts to the part of the key space that owns them; the part adds up and sends the
totals back in the order in which the batch sent its keys. What is shuffled is one short number a
distinct key and batch, so a word that stands in every document is one number a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stage, unstage
from .kernels import BASE, U, expand, expand_sorted, mix, squeeze, squeeze_sorted, strings, word_hashes

#: Bytes of text that a batch has at most, unless one document is longer.
BATCH_BYTES = 8 << 20
#: Distinct keys that a part of the key space gets from all batches together, about.
PART_KEYS = 1 << 21
#: Bits of a bigram's hash: at 10**9 distinct bigrams about seven pairs are expected to meet.
BIGRAM_BITS = 56
#: The hash of the token that ends every document.
END = U(0x1D8AF066E0D5A9C3)
#: Held-out documents: crc32 of the id as text, modulo FOLDS, is HELD.
FOLDS, HELD = 7, 2
#: Estimates are collected for the mixture weights in steps of 1 / GRAIN of a factor of two.
GRAIN = 4
ROUNDS = 60


BATCH = "batch long, part int, ids array<long>, train binary, lengths binary, words binary, tokens binary, keys binary"


def tokenised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a batch of documents: ids, which of them train, token counts, distinct words, and each token's place among these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in batches:
            data, offsets = strings(b.column(2))
            a = 0
            while a < b.num_rows:
                z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BATCH_BYTES, "right")) - 1)
                hashes, first = word_hashes(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
                stream = np.insert(hashes, first[1:], END)
                words, tokens = np.unique(stream, return_inverse=True)
                train = np.asarray(b.column(1).slice(a, z - a)).astype(U)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([-1], pa.int32()), pa.array([b.column(0).slice(a, z - a).to_pylist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (squeeze(train), squeeze(np.diff(first) + 1), squeeze_sorted(words), squeeze(tokens), None))],
                    names=["batch", "part", "ids", "train", "lengths", "words", "tokens", "keys"],
                )
                number, a = number + 1, z

    key = F.col(id_col).cast("long")
    train = F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS != HELD, F.lit(True))
    return docs.select(key.alias("doc_id"), train.cast("int").alias("train"), F.col(text_col).alias("text")).mapInArrow(run, BATCH)


class Batch:
    """A batch's tokens and bigrams, unpacked."""

    def __init__(self, ids: list, train: bytes, lengths: bytes, words: bytes, tokens: bytes):
        self.ids, self.doc_trains = ids, expand(train).astype(bool)
        self.lengths, self.words, self.tokens = expand(lengths).astype(np.int64), expand_sorted(words), expand(tokens).astype(np.int64)
        self.trains = np.repeat(self.doc_trains, self.lengths)
        end = int(np.searchsorted(self.words, END))
        self.before = np.concatenate(([end], self.tokens[:-1]))  # a document's first word follows an end
        pair = mix(self.words[self.before] * U(BASE) + mix(self.words[self.tokens])) >> U(64 - BIGRAM_BITS)
        self.bigrams, self.pairs = np.unique(pair, return_inverse=True)

    def keys(self) -> tuple[tuple[np.ndarray, np.ndarray, int], ...]:
        """(distinct keys, training count of each, bits) of words and of bigrams."""
        count = lambda at, n: np.bincount(at[self.trains], minlength=n).astype(U)
        return (self.words, count(self.tokens, len(self.words)), 64), (self.bigrams, count(self.pairs, len(self.bigrams)), BIGRAM_BITS)


def one_by_one(b: pa.RecordBatch) -> Iterator[dict]:
    """The rows of an Arrow batch; only the one at hand is held as Python objects beside it."""
    for i in range(b.num_rows):
        yield b.slice(i, 1).to_pylist()[0]


def unpacked(row: dict) -> Batch:
    return Batch(*(row[c] for c in ("ids", "train", "lengths", "words", "tokens")))


def totals(table: DataFrame, parts: tuple[int, int]) -> DataFrame:
    """(batch, part, keys): the corpus-wide training counts of the batch's keys, a row for each part; batch -1: a part's count of known keys and their sum."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in one_by_one(b):
                number, part, blobs = row["batch"], [], []
                for kind, (keys, counts, bits) in enumerate(unpacked(row).keys()):
                    own = ((keys >> U(bits - 32)) * U(parts[kind]) >> U(32)).astype(np.int64)
                    cuts = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1, [len(own)]))
                    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                        packed = squeeze_sorted(keys[x:y])
                        part.append(int(own[x]) + kind * parts[0])
                        blobs.append(len(packed).to_bytes(4, "little") + packed + squeeze(counts[x:y]))
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(part), pa.int64()), pa.array(part, pa.int32()), pa.array(blobs, pa.binary())], names=["batch", "part", "keys"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, numbers, blobs = None, [], []

        def told() -> pa.RecordBatch:
            keys, counts = [], []
            for x in blobs:
                n = int.from_bytes(x[:4], "little")
                keys.append(expand_sorted(x[4 : 4 + n]))
                counts.append(expand(x[4 + n :]))
            _, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(at, np.concatenate(counts).astype(float)).astype(U)
            cuts = np.cumsum([len(k) for k in keys])[:-1]
            back = [squeeze(x) for x in np.split(total[at], cuts)]
            facts = squeeze(np.array([(total > 0).sum(), total.sum()], U))
            return pa.RecordBatch.from_arrays([pa.array([*numbers, -1], pa.int64()), pa.array([part] * (len(numbers) + 1), pa.int32()), pa.array([*back, facts], pa.binary())], names=["batch", "part", "keys"])

        for b in batches:
            for number, own, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own != part:
                    if blobs:
                        yield told()
                    part, numbers, blobs = own, [], []
                numbers.append(number)
                blobs.append(blob)
        if blobs:
            yield told()

    n = partitions(table.sparkSession)
    sent = table.mapInArrow(send, "batch long, part int, keys binary").repartition(n, "part").sortWithinPartitions("part", "batch")
    return sent.mapInArrow(add, "batch long, part int, keys binary")


def joined(table: DataFrame, back: DataFrame, parts: tuple[int, int]) -> DataFrame:
    """Each batch's row with the totals of its words (`part` rows below parts[0]) and bigrams, packed in `keys`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, own = None, ([], [])

        def whole() -> pa.RecordBatch:
            packed = [squeeze(np.concatenate(x)) for x in own]
            row["keys"] = len(packed[0]).to_bytes(4, "little") + packed[0] + packed[1]
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for b in batches:
            schema = b.schema
            for r in one_by_one(b):
                if r["part"] < 0:
                    if row:
                        yield whole()
                    row, own = r, ([], [])
                else:
                    own[r["part"] >= parts[0]].append(expand(r["keys"]))
        if row:
            yield whole()

    both = table.unionByName(back.where("batch >= 0"), allowMissingColumns=True)
    return both.repartition(partitions(table.sparkSession), "batch").sortWithinPartitions("batch", "part").mapInArrow(run, BATCH)


def counted(b: pa.RecordBatch) -> Iterator[tuple[Batch, np.ndarray, np.ndarray, np.ndarray]]:
    """Each batch with the training counts, as floats, of every token's word, of the word before it, and of the two together."""
    for row in one_by_one(b):
        it, keys = unpacked(row), row["keys"]
        n = int.from_bytes(keys[:4], "little")
        words, bigrams = expand(keys[4 : 4 + n]).astype(float), expand(keys[4 + n :]).astype(float)
        yield it, words[it.tokens], words[it.before], bigrams[it.pairs]


def bucket(context: np.ndarray) -> np.ndarray:
    """Buckets of context frequency: 0, 1, 2-3, 4-7, ..."""
    return np.frexp(context)[1]


def _ratio(a: np.ndarray, b) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.broadcast_to(np.asarray(b) > 0, a.shape))


def learn(table: DataFrame, n: int, v: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bucket, [bigram, unigram, uniform]) by expectation-maximisation on deleted counts.

    Every training token is held out in turn: its own occurrence is taken off the counts that
    predict it. The estimates are gathered over all training tokens in a table of bounded size
    (buckets times two rounded logarithms), on which the rounds run.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for it, word, context, pair in counted(b):
                t = it.trains
                w, c, p = word[t] - 1, context[t] - 1, pair[t] - 1
                rounded = lambda x: np.where(x > 0, np.round(-GRAIN * np.log2(np.maximum(x, 1e-300))), -1).astype(np.int64)
                packed = (bucket(c).astype(np.int64) << 40) + (rounded(_ratio(p, c)) + 1 << 20) + rounded(_ratio(w, n - 1.0)) + 1
                values, counts = np.unique(packed, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(counts, pa.int64())], names=["cell", "n"])

    cells = table.mapInArrow(gather, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, many = (cells.column(c).to_numpy().astype(np.int64) for c in ("cell", "n"))
    at, q2, q1 = cell >> 40, cell >> 20 & 0xFFFFF, cell & 0xFFFFF
    p = np.stack([np.where(q > 0, 2.0 ** (-(q - 1) / GRAIN), 0.0) for q in (q2, q1)] + [np.full(len(cell), 1.0 / (v + 1))], axis=1)
    weights = np.tile([0.4, 0.4, 0.2], (64, 1))
    weights[0] = [0.0, 0.5, 0.5]  # a context never seen predicts nothing
    if n == 0:
        weights[:] = [0.0, 0.0, 1.0]
    for _ in range(rounds):
        share = weights[at] * p
        share *= (many / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        sums = np.stack([np.bincount(at, share[:, k], minlength=64) for k in range(3)], axis=1)
        known = sums.sum(axis=1) > 0
        weights[known] = sums[known] / sums[known].sum(axis=1, keepdims=True)
    return weights


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_totals: int = PART_KEYS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Tokens are words with A-Z lower-cased and one end. base_score: log10 probability under add-one
    unigrams; score: under P(w | v) = a c(v, w) / c(v) + b c(w) / N + c / (V + 1), the weights a, b, c
    chosen by the bucket of c(v); the word before a document's first is the end. Documents held out
    (FOLDS, HELD) are scored but not learnt from; a null id is learnt from. Null text counts as
    empty (one end). Repeated rows each train and each give a row. Without training documents every
    token has probability 1. An empty table gives no rows. Other columns are not read.
    """
    table = stage(tokenised(docs, id_col, text_col), "lm-batches")
    size = table.agg(F.coalesce(F.sum(F.aggregate("ids", F.lit(0).cast("long"), lambda s, _: s + 1)), F.lit(0)), F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0))).first()
    parts = (max(1, size[1] // (2 * batch_totals)), max(1, size[1] // batch_totals))
    back = stage(totals(table, parts), "lm-totals")

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([expand(k) for k in b.column(0).to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())], names=["v", "n"])

    of_words = back.where((F.col("batch") == -1) & (F.col("part") < parts[0])).select("keys")
    v, n = (int(x or 0) for x in of_words.mapInArrow(facts, "v long, n long").agg(F.sum("v"), F.sum("n")).first())
    full = stage(joined(table, back, parts), "lm-counted")
    unstage(table, back)
    weights = learn(full, n, v)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for it, word, context, pair in counted(b):
                a = weights[bucket(context)]
                p = a[:, 0] * _ratio(pair, context) + a[:, 1] * _ratio(word, float(n)) + a[:, 2] / (v + 1)
                first = np.cumsum(it.lengths) - it.lengths
                add = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
                base = add(np.log10((word + 1) / (n + v + 1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(it.ids, pa.int64()), pa.array(~it.doc_trains), pa.array(it.lengths, pa.int64()), pa.array(add((word > 0).astype(np.int64)), pa.int64()), pa.array(np.full(len(first), n), pa.int64()), pa.array(base), pa.array(add(np.log10(p)))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return full.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
