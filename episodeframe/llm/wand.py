"""Ranked lexical search with variable-block-max WAND over shards of documents.

Documents are read once and become short rows of (term, count) for the terms that queries ask for. A task
turns its rows into shards with posting lists sorted by document; dynamic programming cuts each list into blocks so that
the blocks' maxima say as much as possible; and a query reads only the stretches between block boundaries whose
maxima together reach its tenth best score so far. Shards send their best documents, no more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, unstage
from .kernels import LOWER, chunks, list_array, strings, term_spans

#: Terms (with repeats) that one group of queries has at most; further queries are groups of their own.
QUERY_TERMS = 1_000_000
#: Documents and postings of a shard, at most.
SHARD_DOCS, SHARD_POSTINGS = 1 << 16, 1 << 21
#: Postings of a block at most, and of a stretch of a list that is cut for itself.
BLOCK, STRETCH = 64, 1024
#: A further block costs as much as so many postings whose bound is off by the list's maximum.
BLOCK_COST = 2.0
#: Stretches between block boundaries that a query reads at first; each further round reads four times as many.
FIRST_READ = 16


@dataclass(frozen=True)
class Terms:
    """The distinct terms of a group of queries: sorted hashes (a term's number is its place) and lengths, and each query's terms."""

    hashes: np.ndarray
    lengths: np.ndarray
    queries: list[np.ndarray]

    @staticmethod
    def of(texts: list[bytes]) -> Terms:
        size = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        start, end, first, hashes = term_spans(np.frombuffer(b"".join(texts), np.uint8), size)
        names, where, place = np.unique(hashes, return_index=True, return_inverse=True)
        return Terms(names, (end - start)[where], [np.unique(place[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)])

    def counted(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
        """For runs [i, j) of the texts of a column: number of all terms, numbers of the terms asked for, and their counts."""
        data, offsets = strings(column)
        n = len(self.hashes)
        for i, j in chunks(offsets):
            start, end, first, hashes = term_spans(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            at = np.minimum(np.searchsorted(self.hashes, hashes), n - 1) if n else np.zeros(len(hashes), np.int64)
            asked = np.flatnonzero((self.hashes[at] == hashes) & (self.lengths[at] == end - start)) if n else at[:0]
            key, count = np.unique((np.searchsorted(first, asked, "right") - 1) * n + at[asked], return_counts=True)
            cut = np.searchsorted(key, np.arange(1, j - i) * n)
            yield i, j, np.diff(first), np.split(key % max(1, n), cut), np.split(count, cut)


def rows_of(docs: DataFrame, terms: Terms, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, counts) of every document that has a term."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, n, places, counts in shared.value.counted(b.column(1)):
                columns = [b.column(0).slice(i, j - i), pa.array(n, pa.int64()), list_array([p.astype(np.int32) for p in places], pa.int32()), list_array([c.astype(np.int32) for c in counts], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "terms", "counts"])

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, "id long, n long, terms array<int>, counts array<int>").where("n > 0")


def cut(values: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Marks the first postings of the best blocks of each row's first length[row] values, by dynamic programming over all rows at once:
    the least sum over blocks of length * maximum (what the bounds are off by, but for a constant) + BLOCK_COST * the row's maximum."""
    rows, width = values.shape
    price = BLOCK_COST * values.max(axis=1)
    cost = np.full((rows, BLOCK), np.inf)  # of the best blocks that end 1, 2, ... postings ago
    cost[:, 0] = 0
    high = np.zeros((rows, BLOCK))  # the largest of the last 1, 2, ... values
    back = np.zeros((rows, width), np.int64)
    for j in range(width):
        high[:, 1:] = high[:, :-1].copy()
        high[:, 0] = 0
        np.maximum(high, values[:, j : j + 1], out=high)
        total = cost + high * np.arange(1, BLOCK + 1)
        best = total.argmin(axis=1)
        back[:, j] = best
        cost[:, 1:] = cost[:, :-1].copy()
        cost[:, 0] = total[np.arange(rows), best] + price
    marks = np.zeros((rows, width), bool)
    row, end = np.arange(rows), length - 1
    while len(row):
        first = end - back[row, end]
        marks[row, first] = True
        row, end = row[first > 0], first[first > 0] - 1
    return marks


def blocks(impacts: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """First postings of the blocks of posting lists; list i is impacts[lists[i]:lists[i + 1]]."""
    size = np.diff(lists)
    many = -(-size // STRETCH)
    own = np.repeat(np.arange(len(size)), many)
    start = lists[own] + (np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)) * STRETCH
    length = np.minimum(start + STRETCH, lists[own + 1]) - start
    order = np.argsort(-length, kind="stable")
    found = [np.zeros(0, np.int64)]
    for a in range(0, len(order), 512):  # stretches of about equal length together
        at, n = start[order[a : a + 512]], length[order[a : a + 512]]
        row, column = np.nonzero(cut(impacts[at[:, None] + np.minimum(np.arange(n[0]), n[:, None] - 1)].astype(float), n))
        found.append(at[row] + column)
    return np.sort(np.concatenate(found))


def ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [low, high), one after the other."""
    size = high - low
    return np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size)


class Shard:
    """Posting lists of some documents, in blocks. A document's number is its place by id, null last; ids and none are in that order."""

    def __init__(self, ids: np.ndarray, none: np.ndarray, norms: np.ndarray, size: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, k1: int):
        order = np.lexsort((ids, none))
        self.ids, self.none, self.n = ids[order], none[order], len(ids)
        place = np.empty(self.n, np.int64)
        place[order] = np.arange(self.n)
        doc, terms, counts = np.repeat(place, size), terms.astype(np.int64), counts.astype(np.int64)
        impacts = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + k1 * np.repeat(norms, size)))
        key = terms * self.n + doc
        order = np.argsort(key)
        order = order[impacts[order] > 0]
        self.key, self.impacts = key[order], impacts[order]
        self.lists = np.searchsorted(self.key, np.arange(len(weights) + 1) * self.n)
        self.first = blocks(self.impacts, self.lists)
        self.most = np.maximum.reduceat(self.impacts, self.first) if len(self.first) else self.impacts
        last = np.append(self.first[1:], len(self.key))[: len(self.first)] - 1
        self.low, self.high = self.key[self.first] % max(1, self.n), self.key[last] % max(1, self.n) + 1
        self.own = np.searchsorted(self.first, self.lists)
        self.read = 0

    def scores(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the documents in [low, high) that hold a term."""
        base = terms[:, None] * self.n
        at = ranges(np.searchsorted(self.key, base + low).ravel(), np.searchsorted(self.key, base + high).ravel())
        self.read += len(at)
        doc, place = np.unique(self.key[at] % self.n, return_inverse=True)
        total = np.zeros(len(doc), np.int64)
        np.add.at(total, place, self.impacts[at])
        return doc, total

    def best(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best for a query. Stretches between block boundaries come by falling sum of their blocks' maxima, and
        the rest is skipped, unread, once that sum is below the k-th best score: no document there can reach it. Equal sums are
        read, as a smaller id may be among them."""
        own = ranges(self.own[terms], self.own[terms + 1])
        docs, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(own):
            return docs, found
        edges, place = np.unique(np.concatenate((self.low[own], self.high[own])), return_inverse=True)
        step = np.zeros(len(edges), np.int64)
        np.add.at(step, place, np.concatenate((self.most[own], -self.most[own])))
        bound = np.cumsum(step)[:-1]
        order = np.argsort(-bound, kind="stable")
        a, many = 0, FIRST_READ
        while a < len(order):
            least = found[k - 1] if len(found) >= k else 1
            live = order[a : a + many]
            live = live[bound[live] >= least]
            if not len(live):
                break
            more, scores = self.scores(terms, edges[live], edges[live + 1])
            docs, found = np.concatenate((docs, more)), np.concatenate((found, scores))
            top = np.lexsort((docs, -found))[:k]
            docs, found = docs[top], found[top]
            a, many = a + many, 4 * many
        return docs, found


def best_of_shards(rows: DataFrame, terms: Terms, weights: np.ndarray, docs: int, total: int, k: int, b: int, k1: int) -> DataFrame:
    """(query, id, score): the k best documents of every query in each shard of the rows."""
    shared = rows.sparkSession.sparkContext.broadcast((terms.queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, w = shared.value

        def searched(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ids, lists = t.column("id").combine_chunks(), t.column("terms").combine_chunks()
            n = t.column("n").to_numpy()
            shard = Shard(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), 100 - b + (b * n * docs) // total, np.diff(np.asarray(lists.offsets)), np.asarray(lists.flatten()), np.asarray(t.column("counts").combine_chunks().flatten()), w, k1)
            query, doc, score = [], [], []
            for number, own in enumerate(queries):
                d, s = shard.best(own, k)
                query.append(np.full(len(d), number, np.int32))
                doc.append(d)
                score.append(s)
            doc = np.concatenate(doc) if doc else np.zeros(0, np.int64)
            columns = [pa.array(np.concatenate(query) if query else doc, pa.int32()), pa.array(shard.ids[doc], pa.int64(), mask=shard.none[doc]), pa.array(np.concatenate(score) if score else doc, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["query", "id", "score"])

        held, size = [], [0, 0]
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                piece = batch.slice(i, 1024)
                more = piece.num_rows, len(piece.column(2).flatten())
                if held and (size[0] + more[0] > SHARD_DOCS or size[1] + more[1] > SHARD_POSTINGS):
                    yield searched(held)
                    held, size = [], [0, 0]
                held.append(piece)
                size = [size[0] + more[0], size[1] + more[1]]
        if held:
            yield searched(held)

    return rows.mapInArrow(run, "query int, id long, score long")


def ranked(docs: DataFrame, queries: DataFrame, k: int = 10, b: int = 90, k1: int = 8, query_col: str = "item_id", query_text_col: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The k best documents of every query: `<query_col>, rank, <id_col>, score`, equal scores by ascending id, null ids last.

    Terms are [0-9A-Za-z and all beyond ASCII]+ with A-Z lower-cased. N counts documents with a term, L all their terms,
    n one document's, df the documents that hold a term. A term weighs floor(1000 ln((2N + 2) / (2df + 1))), a document's norm is
    m = 100 - b + (b n N) div L, and it scores the sum of weight * ((10**9 tf) div (1000 tf + k1 m)) over the query's terms,
    once each; only scores above 0 are returned.

    Null texts and texts without terms have none and are never found; a query without terms finds nothing. Every row is a
    document and every query row a query of its own, whatever ids repeat. Empty tables give no rows. Columns beyond those named
    are not read. What moves: rows of the asked terms' counts, staged; documents a term, combined before the shuffle; k documents a query and shard.
    """
    size = queries.agg(F.sum(F.octet_length(query_text_col))).first()[0] or 0
    groups = -(-size // (2 * QUERY_TERMS)) or 1  # a term takes two bytes with what parts it from the next
    parts = [_ranked(docs, queries.where(F.pmod(F.xxhash64(query_text_col), F.lit(groups)) == g), k, b, k1, (query_col, query_text_col, id_col, text_col)) for g in range(groups)]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def _ranked(docs: DataFrame, queries: DataFrame, k: int, b: int, k1: int, columns: tuple[str, str, str, str]) -> DataFrame:
    query_col, query_text_col, id_col, text_col = columns
    spark, names, texts = docs.sparkSession, [], []
    for name, text in queries.select(query_col, F.encode(F.coalesce(query_text_col, F.lit("")), "UTF-8")).toLocalIterator():
        names.append((len(names), name))
        texts.append(bytes(text))
    terms = Terms.of(texts)
    rows = stage(rows_of(docs, terms, id_col, text_col), "wand-rows")
    many, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(1))).first()
    weights = np.zeros(len(terms.hashes), np.int64)
    for term, df in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[term] = math.floor(1000 * math.log((2 * many + 2) / (2 * df + 1)))
    found = stage(best_of_shards(rows, terms, weights, many, total, k, b, k1), "wand-best")
    unstage(rows)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    top = found.withColumn("rank", place).where(F.col("rank") <= k)
    kind = queries.schema[query_col].dataType.simpleString()
    called = spark.createDataFrame(names, f"query int, name {kind}")
    return top.join(F.broadcast(called), "query").select(F.col("name").alias(query_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
