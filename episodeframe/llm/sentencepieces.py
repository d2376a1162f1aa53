"""SentencePiece encoding and decoding with byte offsets into the original text."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

SPACE = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(blob: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message: ints, raw 4 or 8 bytes, or bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = blob[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(blob):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        else:
            n = {1: 8, 5: 4}[kind] if kind != 2 else varint()
            value, i = blob[i : i + n], i + n
        yield key >> 3, value


class CharMap:
    """The compiled character map of a model: a double-array trie of source strings and their replacements."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, np.uint32, n // 4, 4).tolist() if n else []
        self.texts = blob[4 + n :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest mapped prefix at `at`; None if there is none."""
        found, unit = None, self.units[0]
        node = self._offset(unit)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[start : self.texts.index(b"\0", start)]
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)


class Encoder:
    """One model: normalisation with alignment here, segmentation by the sentencepiece library."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, spec = [], b""
        with open(path, "rb") as f:
            for number, value in fields(f.read()):
                if number == 1:
                    pieces.append(dict(fields(value)))
                elif number == 3:
                    spec = value
        rules = dict(fields(spec))
        self.map = CharMap(rules.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        kinds = [p.get(3, 1) for p in pieces]
        # bytes of the normalised text that a piece stands for: a byte piece one, a control piece none
        self.length = np.array([{6: 1, 3: 0, 2: -1}.get(k, len(p[1])) for k, p in zip(kinds, pieces, strict=True)], np.int64)
        self.eos = self.library.eos_id()

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and the end the source byte it comes from.

        All bytes of a replacement align to the start of what it replaces; a prefix that is put in
        aligns to byte 0; removed blanks align to nothing.
        """
        raw = text.encode()
        mark = SPACE.encode() if self.escape else b" "
        if not raw:
            return b"", np.zeros(1, np.int64)
        if not self.map and not self.squeeze:
            src = np.frombuffer(raw, np.uint8)
            reps = np.where(src == 32, len(mark), 1)
            align = np.repeat(np.arange(len(src)), reps)
            out = raw.replace(b" ", mark)
            if self.dummy:
                out, align = mark + out, np.concatenate((np.zeros(len(mark), np.int64), align))
            return out, np.append(align, len(raw))
        parts, align, i = [], [], 0
        while i < len(raw):
            hit = self.map.longest(raw, i) if self.map else None
            if hit is None:
                b = raw[i]
                hit = (n := 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4), raw[i : i + n]
            for j in range(len(hit[1])) if hit[1] == raw[i : i + hit[0]] else [0] * len(hit[1]):
                align.append(i + j)
            parts.append(hit[1])
            i += hit[0]
        flat = b"".join(parts)
        align.append(len(raw))
        out, where = bytearray(), []
        blank = self.squeeze  # leading blanks go
        for byte, at in zip(flat, align, strict=False):
            if byte == 32 and self.squeeze and blank:
                continue
            blank = byte == 32
            new = mark if byte == 32 else bytes([byte])
            out += new
            where += [at] * len(new)
        if self.squeeze:
            while out.endswith(mark):
                del out[-len(mark) :], where[-len(mark) :]
        if self.dummy and out:
            out[:0], where[:0] = mark, [where[0]] * len(mark)
        end = where[-1] if where else 0
        while end < len(raw) and where and end + 1 < len(raw) and raw[end + 1] & 0xC0 == 0x80:
            end += 1
        return bytes(out), np.array([*where, min(end + 1, len(raw)) if self.squeeze else len(raw)], np.int64)

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) in bytes of the original text for every id; control ids get an empty span at the end.

        The pieces must tile the normalised bytes: if the library's normalisation differs from the one aligned here, it is an error.
        """
        _, align = self.normalise(text)
        lengths = self.length[ids] if len(ids) else np.zeros(0, np.int64)
        if (lengths < 0).any():  # unknown pieces: their own text tells the length
            shown = self.library.encode(text, out_type=str)
            lengths = np.array([len(p.encode()) for p in shown] + [0] * (len(ids) - len(shown)), np.int64)
        ends = np.cumsum(lengths)
        if len(ids) and ends[-1] != len(align) - 1:
            raise ValueError(f"pieces of {ends[-1]} bytes for a normalised text of {len(align) - 1}")
        return align[ends - lengths] if len(ids) else ends, align[ends]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with the end id."""
        return [x + [self.eos] for x in self.library.encode(texts, num_threads=1)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _texts(column: pa.Array, size: int = 256) -> Iterator[list[str]]:
    for i in range(0, len(column), size):
        yield [t or "" for t in column.slice(i, size).to_pylist()]


def encode_documents(docs: DataFrame, text_col: str = "text", model: str | None = None, out: str = "") -> DataFrame:
    """docs with `ids` (end id last), `begins`, `ends` (byte spans in the original text); names get the prefix `out`.

    Null text counts as empty: the end id alone. A column of docs with one of these names is replaced.
    """
    path = model or default_model()
    names = [out + c for c in ("ids", "begins", "ends")]
    docs = docs.drop(*names)
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = encoder(path)
        for b in batches:
            made: list[list] = [[], [], []]
            for texts in _texts(b.column(b.schema.get_field_index(text_col))):
                for t, ids in zip(texts, it.encode(texts), strict=True):
                    for k, x in enumerate((ids, *it.spans(t, ids))):
                        made[k].append(x)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, ints) for x in made)], names=[*b.schema.names, *names])

    schema = StructType([*docs.schema.fields])
    for c in names:
        schema.add(c, ArrayType(IntegerType()))
    return docs.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ids_col: str = "ids", out: str = "decoded", model: str | None = None) -> DataFrame:
    """encoded with the decoded text of each id list; null or empty lists decode to the empty text."""
    path = model or default_model()
    encoded = encoded.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = encoder(path)
        for b in batches:
            column, made = b.column(b.schema.get_field_index(ids_col)), []
            for i in range(0, len(column), 256):
                made += it.decode([x or [] for x in column.slice(i, 256).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, out])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields]).add(out, "string"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes of every text, encoded and decoded in one task.

    The same Encoder as encode_documents and decode_documents; only digests leave the task.
    covered_bytes is the sum of the pieces' source spans. Null text is empty; repeated rows and
    null ids each give a row; no other columns are read.
    """
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = encoder(path)
        shown = [str(i) for i in range(it.library.get_piece_size())]
        for b in batches:
            counts, a, d, covered = [], [], [], []
            for texts in _texts(b.column(1)):
                coded = it.encode(texts)
                for t, ids, back in zip(texts, coded, it.decode(coded), strict=True):
                    begins, ends = it.spans(t, ids)
                    counts.append(len(ids))
                    covered.append(int((ends - begins).sum()))
                    a.append(hashlib.sha256(" ".join([shown[i] for i in ids]).encode()).hexdigest())
                    d.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(a), pa.array(d), pa.array(covered, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long")
