"""Array kernels that run inside tasks: words and hashes of Arrow string batches, without Python strings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that no term has: ASCII but for letters and digits.
NO_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
CHUNK = 1 << 20
#: Bytes hashed at a time.
HASHED = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, U(BASE)), np.full(n, U(pow(BASE, -1, 1 << 64)))
    up[0] = down[0] = U(1)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least n of each."""
    return _powers(max(2 * CHUNK, 1 << (n - 1).bit_length()) if n > 1 else 2 * CHUNK)


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """cs with cs[i] = sum of (values[j] + 1) * BASE**j for j < i; span_hash() reads it."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum((values.astype(U) + U(1)) * up[: len(values)], out=out[1:])
    return out


def span_hash(cs: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span that depends on its content and length only."""
    _, down = powers(len(cs))
    return mix((cs[end] - cs[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """span_hash() of spans with ascending starts, a stretch of the data at a time: arrays of eight bytes a byte, and the powers kept, stay small."""
    out = np.empty(len(start), U)
    for a, z in chunks(np.append(start, end[-1:]), HASHED):
        low = start[a]
        out[a:z] = span_hash(prefix_hash(data[low : end[z - 1]]), start[a:z] - low, end[a:z] - low)
    return out


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """span_hash() of every `gram` consecutive bytes."""
    n = max(0, len(data) - gram + 1)
    out = np.empty(n, U)
    for x in range(0, n, HASHED):
        at = np.arange(min(HASHED, n - x))
        out[x : x + len(at)] = span_hash(prefix_hash(data[x : x + len(at) + gram - 1]), at, at + gram)
    return out


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty. offsets[0] is 0."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and n else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of documents of about `limit` bytes; one longer document is a run of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of the words (bytes outside `blank`: [^\\x20\\x09-\\x0D]+), and for document i its words first[i]..first[i+1]."""
    solid = ~blank[data]
    opens, shuts = solid.copy(), np.ones(len(data), bool)
    opens[1:] &= ~solid[:-1]
    shuts[:-1] = ~solid[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    opens[edge] = solid[edge]
    shuts[edge - 1] = True
    start, end = np.flatnonzero(opens), np.flatnonzero(shuts & solid) + 1
    return start, end, np.searchsorted(start, offsets)


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first, hash) of the terms [0-9A-Za-z\\x80-]+ of a chunk; the hash is of the term with A-Z lower-cased."""
    start, end, first = words(data, offsets, NO_TERM)
    return start, end, first, span_hash(prefix_hash(LOWER[data]), start, end)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lower-cased, first)."""
    start, end, first = words(data, offsets)
    return span_hashes(LOWER[data], start, end), first


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each document; fewer words: the whole sequence as one."""
    w, first = word_hashes(data, offsets)
    count = np.diff(first)
    run = np.full(max(0, len(w) - k + 1), U(k))
    for j in range(k if len(run) else 0):
        run = mix(run * U(BASE) + w[j : j + len(run)])
    out = []
    for i in range(len(count)):
        a, n = int(first[i]), int(count[i])
        if n >= k:
            out.append(np.unique(run[a : a + n - k + 1]))
        elif n:
            h = np.full(1, U(n))
            for j in range(n):
                h = mix(h * U(BASE) + w[a + j : a + j + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, U))
    return out


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one numpy array per row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    values = pa.array(flat.view(np.int64) if flat.dtype == U else flat, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, compressed; ascending ones are best sent as differences."""
    planes = np.ascontiguousarray(values.astype(U).view(np.uint8).reshape(-1, 8).T)
    width = int(planes.any(axis=1).sum() and np.flatnonzero(planes.any(axis=1)).max() + 1)
    return bytes([width]) + len(values).to_bytes(4, "little") + (pa.compress(planes[:width].tobytes(), "zstd", asbytes=True) if width else b"")


def expand(blob: bytes) -> np.ndarray:
    width, n = blob[0], int.from_bytes(blob[1:5], "little")
    planes = np.zeros((8, n), np.uint8)
    if width:
        planes[:width] = np.frombuffer(pa.decompress(blob[5:], width * n, "zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(U).reshape(n)


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values.astype(U), prepend=U(0)))


def expand_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(expand(blob), dtype=U)
