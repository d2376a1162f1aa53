"""Token ids as a content-addressed store: chunks by rolling hash, document recipes, Merkle manifest.

A store is a folder of three Parquet tables:
  chunks/    address (sha256 of the ids as little-endian unsigned 32-bit), n, ids (16-bit if all fit, else 32-bit)
  recipes/   bucket, doc_id, start, n_tokens, addresses; files hold consecutive ranges in ascending doc_id order
  manifest/  bucket, documents, tokens, root (hash over the bucket's documents); bucket -1 has the store's root
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise
from operator import attrgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, partitions, range_bucket, running_start, small, stage, unstage, write
from .kernels import U, chunks, list_array, mix, strings

END = 0
#: Ids a chunk has at least and at most; between them a rolling hash over WINDOW ids cuts with chance 1 / MEAN.
LEAST, MOST, MEAN, WINDOW = 64, 4096, 256, 16
#: Bytes of text that are encoded at a time (one longer document is encoded alone).
TEXT_BYTES = 4 << 20
#: Pieces, of at most SHORT bytes each, whose ids a worker keeps; the table is emptied when full. A piece's length stands in its sixteenth byte.
MEMO, SHORT = 1_000_000, 15
#: Bytes of pieces that the library gets at a time.
LINES = 1 << 16


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Byte classes: letters (of ASCII and U+00C0 to U+023F), digits and other visible characters of ASCII; blanks; the apostrophe; other bytes beyond ASCII; 0: controls.
LETTER, DIGIT, SIGN, BLANK, QUOTE, WIDE = range(1, 7)
CLASS = np.zeros(256, np.uint8)
CLASS[0x21:0x7F] = SIGN
CLASS[ord("0") : ord("9") + 1] = DIGIT
CLASS[ord("A") : ord("Z") + 1] = CLASS[ord("a") : ord("z") + 1] = LETTER
CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = BLANK
CLASS[ord("'")] = QUOTE
CLASS[0x80:] = WIDE
#: Blanks beyond ASCII (fixed values).
WIDE_BLANKS = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: Bytes that open one of them, and bytes (by class) that no line of pieces has.
OPENER, UNLINED = np.zeros(256, bool), np.zeros(7, bool)
OPENER[[b[0] for b in WIDE_BLANKS]] = UNLINED[[0, BLANK]] = True
#: The byte-level alphabet's characters: visible ones of Latin-1 stand for themselves, the others for those from U+0100 on in their order; lines keep their feeds.
HIDDEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
ALPHABET = np.arange(256, dtype="<u4")
ALPHABET[HIDDEN] = 0x100 + np.arange(len(HIDDEN))
ALPHABET[0x0A] = 0x0A
#: The bytes of a piece's first and second word, by its length.
HEAD = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(SHORT + 1)], U)
TAIL = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(SHORT + 1)], U)


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """The bytes' classes; the last byte of a blank beyond ASCII has a control's."""
    kind = CLASS[data]
    at = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC8))
    at = at[(data[at] > 0xC3) | (data[at + 1] & 0xDF != 0x97)]  # all but the signs of multiplication and division are letters
    kind[at] = kind[at + 1] = LETTER
    open_ = np.flatnonzero(OPENER[data])
    for raw in WIDE_BLANKS if len(open_) else ():
        at = open_[open_ <= len(data) - len(raw)]
        for j, byte in enumerate(raw):
            at = at[data[at + j] == byte]
        kind[at + len(raw) - 1] = 0
    return kind


def as_lines(values: np.ndarray, at: np.ndarray, n: np.ndarray, feed: int) -> tuple[np.ndarray, np.ndarray]:
    """(values[at : at + n] of every piece, `feed` behind each; where the pieces start, and the end)."""
    ends = np.append(0, np.cumsum(n + 1))
    place = np.repeat(at - ends[:-1], n + 1) + np.arange(ends[-1])
    place[ends[1:] - 1] = 0
    out = values[place]
    out[ends[1:] - 1] = feed
    return out, ends


def piece_starts(data: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a piece starts at a byte, where the byte-level pre-tokenizer always cuts: at a document's start, before a
    blank after anything visible, between LETTER, DIGIT and SIGN, and behind a lone blank that is no space."""
    out = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        before, here = kind[:-1], kind[1:]
        plain, ascii_ = (here >= LETTER) & (here <= SIGN), (before >= LETTER) & (before <= SIGN)
        out[1:-1] = (here == BLANK) & (before != BLANK) & (before > 0) | plain & ascii_ & (here != before)
        lone = (before == BLANK) & (data[:-1] != 0x20) & plain
        lone[1:] &= (kind[:-2] != BLANK) & (kind[:-2] > 0)
        lone[:1] = False
        out[1:-1] |= lone
    out[offsets] = True
    return out[:-1]


class PieceEncoder:
    """Ids of texts by the tokenizers library, which gets each distinct piece of a batch once.

    A text's ids are its pieces' ids in a row if the tokenizer is byte-level without a normaliser;
    texts that hold an added token's string, and all texts of other tokenizers, are one piece
    each. Short pieces are told apart by their bytes, held in two words, and remembered across batches.
    Most of the library's time goes into cutting, so pieces of one class (LETTER, DIGIT or SIGN), with
    a space in front or not, go to it without a pre-tokenizer: it would leave them whole. Others without
    further blanks go as lines of longer texts: it cuts before and behind a line feed there.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        first = known.get("pre_tokenizer") or {}
        self.cuts = not known.get("normalizer") and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
        self.added = [t["content"].encode() for t in known.get("added_tokens", ())]
        feed = self.library.encode("\n", add_special_tokens=False).ids
        plain = not known.get("truncation") and not known.get("padding") and not any(b"\n" in t for t in self.added)
        self.feed = feed[0] if self.cuts and plain and len(feed) == 1 else None
        self.bare = Tokenizer.from_file(path)
        self.bare.pre_tokenizer = None
        self.forget()

    def forget(self) -> None:
        self.keys, self.slots = np.zeros(0, U), np.zeros(0, np.int64)
        self.facts = np.zeros((0, 2), U)
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def library_ids(self, pieces: list[str], library=None) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, number of each piece's)."""
        found = list(map(attrgetter("ids"), (library or self.library).encode_batch_fast(pieces, add_special_tokens=False)))
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum())), n

    def bare_ids(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """library_ids() of lines that the pre-tokenizer would leave whole."""
        return self.library_ids(ALPHABET[lines[:-1]].tobytes().decode("utf-32-le").split("\n"), self.bare)

    def line_ids(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """library_ids() of lines without blanks but for a space in front."""
        ids, _ = self.library_ids([lines.tobytes().decode()])
        feeds = ids == self.feed
        return ids[~feeds], np.diff(np.flatnonzero(feeds), prepend=-1) - 1

    def piece_ids(self, data: np.ndarray, kind: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(an order of the pieces data[at : at + n], their ids in a row in that order, number of each piece's)."""
        way = np.full(len(n), 2)
        if self.feed is not None and len(n):
            kinds, ends = as_lines(kind, at, n, LETTER)
            front = data[at] == 0x20
            lined = (np.add.reduceat(UNLINED[kinds], ends[:-1], dtype=np.int64) == front) & (n > front)
            way[lined] = np.bitwise_or.reduceat(kinds > BLANK, ends[:-1])[lined]
        order = np.argsort(way, kind="stable")
        at, n, way = at[order], n[order], way[order]
        found = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))]
        for some, ids in ((way == 0, self.bare_ids), (way == 1, self.line_ids)):
            text, ends = as_lines(data, at[some], n[some], 0x0A)
            found += [ids(text[ends[a] : ends[z]]) for a, z in chunks(ends, LINES)]
        some = way == 2
        found.append(self.library_ids([data[x:y].tobytes().decode() for x, y in zip(at[some].tolist(), (at + n)[some].tolist(), strict=True)]))
        ids, many = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(many) != len(n):
            raise ValueError("the library does not part pieces at line feeds")
        return order, ids, many

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents in a row, each with the end id after it; where each document ends)."""
        if len(self.keys) > MEMO:
            self.forget()
        kind = byte_kinds(data)
        opens = piece_starts(data, kind, offsets) if self.cuts else np.isin(np.arange(len(data)), offsets)
        blob = data.tobytes()
        for token in self.added if self.cuts else ():
            at = blob.find(token)
            while at >= 0:
                doc = int(np.searchsorted(offsets, at, "right"))
                opens[at + 1 : offsets[doc]] = False
                opens[offsets[doc - 1] + 1 : at + 1] = False
                kind[at] = 0  # goes to the library alone
                at = blob.find(token, int(offsets[doc]))
        start = np.flatnonzero(opens)
        size = np.diff(start, append=len(data))
        short = size <= SHORT
        # a piece's first and second eight bytes
        padded = np.concatenate((data, np.zeros(16, np.uint8)))
        words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        at, n = start[short], size[short]
        head, tail = words[at] & HEAD[n], words[np.minimum(at + 8, len(data))] & TAIL[n] | n.astype(U) << U(56)
        code, key = pd.factorize(mix(head + mix(tail)))
        own = np.empty(len(key), np.int64)
        own[code] = np.arange(len(code))
        facts = np.stack((head[own], tail[own]), axis=1)
        if not ((head == facts[code, 0]).all() and (tail == facts[code, 1]).all()):
            raise ValueError("two pieces have the same 64-bit hash")
        place = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        known = self.keys[place] == key if len(self.keys) else np.zeros(len(key), bool)
        slot = np.empty(len(key), np.int64)
        slot[known] = self.slots[place[known]]
        if known.any() and not (self.facts[slot[known]] == facts[known]).all():
            raise ValueError("two pieces have the same 64-bit hash")
        new = np.flatnonzero(~known)
        if len(new):
            order, ids, many = self.piece_ids(data, kind, at[own[new]], n[own[new]])
            new = new[order]
            slot[new] = len(self.ends) - 1 + np.arange(len(new))
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(many)))
            self.ids = np.concatenate((self.ids, ids))
            self.facts = np.concatenate((self.facts, facts[new]))
            order = np.argsort(key[new])
            into = np.searchsorted(self.keys, key[new][order])
            self.keys, self.slots = np.insert(self.keys, into, key[new][order]), np.insert(self.slots, into, slot[new][order])
        # long pieces, and the end of each document, stand behind the table for this batch only
        at, n = start[~short], size[~short]
        each: dict[bytes, int] = {}
        long = [each.setdefault(blob[x : x + y], i) for i, (x, y) in enumerate(zip(at.tolist(), n.tolist(), strict=True))]
        distinct, long = np.unique(np.array(long, np.int64), return_inverse=True)
        order, more, many = self.piece_ids(data, kind, at[distinct], n[distinct])
        ids = np.concatenate((self.ids, more, np.array([end], np.uint32)))
        ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(np.append(many, 1))))
        which = np.empty(len(start), np.int64)
        which[short] = slot[code]
        which[~short] = len(self.ends) - 1 + np.argsort(order)[long]
        which = np.insert(which, np.searchsorted(start, offsets[1:]), len(ends) - 2)
        count = ends[which + 1] - ends[which]
        stop = np.cumsum(count)
        stream = ids[np.repeat(ends[which] - stop + count, count) + np.arange(stop[-1] if len(stop) else 0)]
        return stream, stop[which == len(ends) - 2]


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def cut_points(ids: np.ndarray, stops: np.ndarray | None = None) -> np.ndarray:
    """Chunk ends of an id stream; its documents end at `stops`. They depend on nearby ids only, so shared runs share chunks."""
    n = len(ids)
    h = mix(ids.astype(U) + U(1))
    span = 1
    while span < WINDOW:  # h[i] becomes the sum of g[i - j] << j over the window
        h[span:] = h[span:] + (h[:-span] << U(span))
        span *= 2
    # the window of a cut lies in its document: a chunk has at least LEAST > WINDOW ids
    marks = np.flatnonzero((mix(h) & U(MEAN - 1)) == 0) + 1
    stops = np.array([n] if n else [], np.int64) if stops is None else stops
    out: list[int] = []
    last, at = 0, 0
    firsts = np.searchsorted(marks, stops).tolist()
    marks = marks.tolist()
    for stop, to in zip(stops.tolist(), firsts, strict=True):
        for m in [*marks[at:to], stop]:
            while m - last > MOST:
                last += MOST
                out.append(last)
            if m - last >= LEAST or m == stop and m > last:
                out.append(m)
                last = m
        at = to
    return np.array(out, np.int64)


def pack(ids: np.ndarray) -> bytes:
    """The ids in 16 bits each if all fit, else in 32."""
    return ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else ids.astype("<u4").tobytes()


def unpack(blob: bytes | np.ndarray, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4").astype("<u4")


def encoded(docs: DataFrame, tokenizer: str, end: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_tokens, addresses, and the chunks (address, n, ids) that the task had not met before."""
    kind = pa.struct([("address", pa.binary()), ("n", pa.int32()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it, met = piece_encoder(tokenizer), set()
        for b in batches:
            data, offsets = strings(b.column(1))
            for i, j in chunks(offsets, TEXT_BYTES):
                ids, stops = it.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end)
                cuts = cut_points(ids, stops)
                blob, at = ids.astype("<u4").tobytes(), 0
                # 16 bits an id, if they do for all
                halves = pack(ids) if not len(ids) or ids.max() < 1 << 16 else None
                names, owner, new = [], np.searchsorted(stops, cuts, "left"), []
                for place, cut in enumerate(cuts.tolist()):
                    name = hashlib.sha256(blob[4 * at : 4 * cut]).digest()
                    names.append(name)
                    if name not in met:
                        new.append((place, name, cut - at, pack(ids[at:cut]) if halves is None else halves[2 * at : 2 * cut]))
                        if len(met) < 1_000_000:
                            met.add(name)
                    at = cut
                lists = lambda own, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(j - i + 1)), pa.int32()), values)
                place, *columns = zip(*new) if new else ([], [], [], [])
                fresh = pa.StructArray.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, kind, strict=True)], fields=list(kind))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(np.diff(stops, prepend=0), pa.int64()), lists(owner, pa.array(names, pa.binary())), lists(owner[list(place)] if new else owner[:0], fresh)],
                    names=["doc_id", "n_tokens", "addresses", "chunks"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, addresses array<binary>, chunks array<struct<address: binary, n: int, ids: binary>>")


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a bucket from recipes sorted by bucket and start: a hash chain over (doc_id, addresses)."""
    key, docs, tokens, h = None, 0, 0, hashlib.sha256()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64()), pa.array([h.hexdigest()])], names=["bucket", "documents", "tokens", "root"])

    for b in batches:
        for bucket, doc, n, names in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if bucket != key:
                if key is not None:
                    yield row()
                key, docs, tokens, h = bucket, 0, 0, hashlib.sha256()
            docs, tokens = docs + 1, tokens + n
            h.update(hashlib.sha256(repr(doc).encode() + b"".join(names)).digest())
    if key is not None:
        yield row()


def merkle(buckets: DataFrame) -> str:
    """Root over the bucket roots in order; one short row a bucket, of which there are a few per task."""
    level = [r.root for r in buckets.where("bucket >= 0").orderBy("bucket").select("root").collect()]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + 2]).encode()).hexdigest() for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").hexdigest()


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the store at `path`; only library calls see the texts.

    Null text is empty (the end id alone). Documents stand in ascending id order, null ids first;
    repeated rows are kept, those with equal ids ordered by their addresses. An empty table gives
    a store without rows. Chunk payloads are shuffled once, by address, after each task has
    dropped those it met before, so a chunk that a third of all documents share stays one row a task.
    """
    spark = docs.sparkSession
    work = stage(encoded(docs, tokenizer or default_tokenizer(), end, id_col, text_col), "store-work")
    chunks = work.select(F.inline("chunks")).repartition(partitions(spark), "address").sortWithinPartitions("address").dropDuplicates(["address"])
    write(chunks, f"{path}/chunks")
    rows = range_bucket(work.select("doc_id", "n_tokens", "addresses"), "doc_id", 2 * partitions(spark))
    placed = running_start(rows, [F.col("doc_id").asc_nulls_first(), "addresses"], "n_tokens", "start", partitions(spark)).select("bucket", "doc_id", "start", "n_tokens", "addresses")
    write(placed.sortWithinPartitions("bucket", "start"), f"{path}/recipes")
    whole = spark.read.parquet(f"{path}/recipes").select("bucket", "doc_id", "n_tokens", "addresses", "start").repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "start").drop("start")
    roots = stage(whole.mapInArrow(_roots, "bucket int, documents long, tokens long, root string"), "store-roots")
    total = roots.agg(F.lit(-1).alias("bucket"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.lit(merkle(roots)).alias("root"))
    roots.union(total).write.parquet(f"{path}/manifest")
    unstage(work, roots)


def check_manifest(spark: SparkSession, path: str) -> bool:
    """Whether the store's root follows from its recipes."""
    whole = spark.read.parquet(f"{path}/recipes").repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "start")
    roots = whole.select("bucket", "doc_id", "n_tokens", "addresses").mapInArrow(_roots, "bucket int, documents long, tokens long, root string")
    told = spark.read.parquet(f"{path}/manifest").where("bucket = -1").first()
    return told.root == merkle(roots)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids of every document, put together from its chunks."""
    chunks = spark.read.parquet(f"{path}/chunks")
    parts = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", F.posexplode("addresses").alias("pos", "address"))
    listed = parts.join(chunks, "address").groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "ids"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.concatenate([unpack(p["ids"], p["n"]) for p in row]).astype(np.int32) for row in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), list_array(ids, pa.int32())], names=["doc_id", "start", "ids"])

    return listed.mapInArrow(run, "doc_id long, start long, ids array<int>")


#: The polynomial of CRC-32, bits reversed.
POLY = U(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of reversed 32-bit polynomials modulo POLY."""
    out, b = np.zeros(np.broadcast(a, b).shape, U), np.broadcast_to(b, np.broadcast(a, b).shape).copy()
    for bit in range(31, -1, -1):
        out ^= np.where(a >> U(bit) & U(1), b, U(0))
        b = np.where(b & U(1), (b >> U(1)) ^ POLY, b >> U(1))
    return out


@lru_cache(maxsize=1)
def _squares() -> tuple[np.ndarray, ...]:
    """x ** (8 * 2 ** k) for k = 0..47."""
    x = np.array([1 << 30], U)
    for _ in range(3):
        x = _times(x, x)
    out = [x]
    while len(out) < 48:
        out.append(_times(out[-1], out[-1]))
    return tuple(out)


def shifted_crc(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a part's CRC-32 adds to the whole's when `after` bytes follow; the whole's is the parts' XOR."""
    out, k = crc.astype(U), 0
    while k < 48 and (after >> k).any():
        out = np.where(after >> k & 1, _times(out, _squares()[k]), out)
        k += 1
    return out


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    Every chunk is read, checked against its address and reduced to its length and CRC in place;
    a document's CRC follows from its chunks', so only short rows are shuffled. A damaged or missing
    chunk, a document that its chunks don't fill, and recipes that the manifest does not fit are errors.
    """
    if not check_manifest(spark, path):
        raise ValueError(f"the recipes of {path} are not those of its manifest")

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc, sizes = [], b.column(1).to_numpy().astype(np.int64)
            data, offsets = strings(b.column(2))
            if (np.diff(offsets) == 2 * sizes).all():  # 16 bits an id in all of them
                whole, ends = memoryview(unpack(data, len(data) // 2).tobytes()), (2 * offsets).tolist()
                raws = [whole[x:y] for x, y in pairwise(ends)]
            else:
                raws = [unpack(data[x:y], n).tobytes() for (x, y), n in zip(pairwise(offsets.tolist()), sizes.tolist(), strict=True)]
            for name, raw in zip(b.column(0).to_pylist(), raws, strict=True):
                if hashlib.sha256(raw).digest() != name:
                    raise ValueError(f"chunk {name.hex()} is damaged")
                crc.append(zlib.crc32(raw))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(crc, pa.int64())], names=["address", "n", "crc"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(2).to_pylist()
            sizes = np.array([len(r) for r in rows])
            crc = np.array([p["crc"] for r in rows for p in r], np.int64)
            n = np.array([p["n"] for r in rows for p in r], np.int64)
            first = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
            ends = np.cumsum(n)
            total = np.add.reduceat(n, first) if len(n) else n
            if (total != b.column(3).to_numpy()).any():
                raise ValueError("a chunk of a document is missing")
            after = np.repeat(ends[first + sizes - 1], sizes) - ends if len(n) else n
            whole = np.bitwise_xor.reduceat(shifted_crc(crc, 4 * after), first) if len(n) else crc
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total, pa.int64()), pa.array(whole.astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    chunks = spark.read.parquet(f"{path}/chunks").select("address", "n", "ids")
    known = stage(chunks.mapInArrow(facts, "address binary, n int, crc long"), "store-facts")
    recipes = spark.read.parquet(f"{path}/recipes")
    parts = recipes.select("doc_id", "start", "n_tokens", F.posexplode("addresses").alias("pos", "address"))
    fact = F.struct("pos", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("crc", F.lit(0)).alias("crc"))
    listed = parts.join(small(known), "address", "left").groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(fact)).alias("parts"), F.first("n_tokens").alias("n_tokens"))
    return listed.mapInArrow(joined, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_digests(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write docs to a store (in the shared folder if no path is given) and digest what its files hold."""
    path = path or new_path(docs.sparkSession, "store")
    write_store(docs, path, tokenizer)
    return read_digests(docs.sparkSession, path)
