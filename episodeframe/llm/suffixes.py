"""Repeated passages by suffix arrays of shards, merged across shards.

A passage is a window of `width` bytes. Windows are keyed by the least hash of the k-byte strings in
them, so equal windows have equal keys; a run is a stretch of consecutive windows with one key. Runs
whose key stands once in the corpus hold no repeat and go no further. The rest are cut into shards.
Each shard's suffix array is built by Larsson-Sadakane refinement to the window's depth, Kasai's
common prefixes mark the windows that repeat inside the shard, and only the first of equal windows
leaves it. Those meet by key, and the shards' lists are merged by binary search, confirmed byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, small, stage, unstage
from .kernels import HASHED, U, chunks, gram_hashes, list_array, mix, prefix_hash, span_hash, span_hashes, strings

WIDTH = 100
#: Bytes of the strings whose least hash keys a window.
GRAM = 32
#: Bytes of a shard: three fields of SHARD_BITS fit a 64-bit sort key.
SHARD_BITS = 21
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 20
#: Bits of a run's number of windows in its span: a run may fill a piece, so PIECE < 1 << SPAN_BITS.
SPAN_BITS = 24
#: The windows of a key with more runs than this are dealt one by one.
HOT = 4096
#: Windows that are dealt at a time, one by one.
EACH_WINDOWS = 1 << 14
#: Bytes of runs that are merged at a time, of whole keys.
MERGE_BYTES = 4 << 20


def sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) over each window of `width` elements."""
    span = 1
    while 2 * span <= width:
        x = least(x[:-span], x[span:])
        span *= 2
    return x if span == width else least(x[: len(x) - (width - span)], x[width - span :])


def runs(data: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, windows) of the runs of a text, and the keys that stand more than once in one run."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    h = gram_hashes(data, gram)
    over = width - gram + 1
    key = sliding(h, over, np.minimum)
    start = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
    # a string is a run's key at every place where no window over it has a lesser one
    padded = np.concatenate((np.zeros(over - 1, U), key, np.zeros(over - 1, U)))
    places = h[h == sliding(padded, over, np.maximum)]
    values, counts = np.unique(places, return_counts=True)
    return key[start], start, np.diff(start, append=n), values[counts > 1]


def suffix_array(text: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """Start positions in the order of their next `depth` bytes, equal ones by position.

    Larsson-Sadakane: positions are grouped by a prefix whose length doubles each round, and only
    groups of more than one are sorted again, by the rank of what follows. `text` has at most
    2 ** SHARD_BITS - 1 bytes; what lies beyond its end is less than any byte.
    """
    n = len(text)
    bits, mask = U(SHARD_BITS), U((1 << SHARD_BITS) - 1)
    order = np.zeros(n, U)
    for j in range(4):  # four 9-bit symbols, then the position
        order <<= U(9)
        order[: max(0, n - j)] += text[j:]
        order[: max(0, n - j)] += U(1)
    order <<= bits
    order |= np.arange(n, dtype=np.uint32)
    order.sort()
    sa = (order & mask).astype(np.uint32)
    order >>= bits
    fresh = np.concatenate(([True], order[1:] != order[:-1])) if n else np.zeros(0, bool)
    del order
    rank = np.zeros(n + depth + 1, np.uint32)  # 0: beyond the end
    rank[sa] = leaders(fresh) + np.uint32(1)
    known = 4
    while known < depth and n:
        alone = fresh & np.append(fresh[1:], True)
        left = np.flatnonzero(~alone).astype(np.uint32)  # places in sa that are not settled
        if not len(left):
            break
        step = min(known, depth - known)
        at = sa[left]
        order = rank[at].astype(U)
        order <<= bits
        order |= rank[at + np.uint32(step)]
        order <<= bits
        order |= at
        del at
        order.sort()
        at = (order & mask).astype(np.uint32)
        sa[left] = at
        order >>= bits
        new = np.concatenate(([True], order[1:] != order[:-1]))
        del order
        fresh[left] = new
        rank[at] = left[leaders(new)] + np.uint32(1)
        known += step
    return sa.view(np.int32)


def leaders(fresh: np.ndarray) -> np.ndarray:
    """For each place the last place up to it that is fresh."""
    at = np.arange(len(fresh), dtype=np.uint32)
    at[~fresh] = 0
    return np.maximum.accumulate(at, out=at)


def matching(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a[i] and b[i]."""
    n = len(text)
    out, live, done = np.zeros(len(a), np.int64), np.arange(len(a)), 0
    wide = np.concatenate((text, np.zeros(8, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(wide, 8)
    while len(live):
        x, y = a[live] + done, b[live] + done
        room = np.minimum(n - np.maximum(x, y), 8)
        ok = room > 0
        live, x, y, room = live[ok], x[ok], y[ok], room[ok]
        same = words[x] == words[y]
        prefix = np.minimum(np.where(same.all(axis=1), 8, same.argmin(axis=1)), room)
        out[live] += prefix
        live = live[prefix == 8]
        done += 8
    return out


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix of sa and the one before it in sa (the first: 0).

    Kasai: where the suffix before moves along with a position, the prefix is one less than the
    position before had. So prefixes are measured only where such a chain begins.
    """
    n = len(sa)
    if n < 2:
        return np.zeros(n, np.int32)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]

    def measured(at: np.ndarray, into: np.ndarray) -> None:
        for x in range(0, len(at), HASHED):
            own = at[x : x + HASHED]
            into[own] = matching(text, own, before[own])

    heads = np.concatenate(([True], before[1:] != before[:-1] + 1)) & (before >= 0)
    length = np.zeros(n, np.int32)
    measured(np.flatnonzero(heads), length)
    last = leaders(heads | (before < 0)).view(np.int32)
    plcp = length[last]
    del length
    plcp -= np.arange(n, dtype=np.int32)
    plcp += last
    plcp[before < 0] = 0
    measured(np.flatnonzero((plcp < 0) | (before >= 0) & (plcp == 0) & ~heads), plcp)  # a chain that went on past its prefix
    return plcp[sa]


def stretches(flags: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of the runs of flagged places; a run also ends before a place where cuts is set."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    start = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | cuts[at[1:]])))
    return at[start], np.diff(start, append=len(at))


def sliced(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """A binary column of slices of data."""
    offsets = np.concatenate(([0], np.cumsum(length)))
    flat = np.empty(offsets[-1], np.uint8)
    for a, z in chunks(offsets, HASHED):
        flat[offsets[a] : offsets[z]] = data[np.repeat(start[a:z] - offsets[a:z], length[a:z]) + np.arange(offsets[a], offsets[z])]
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)])


#: Runs of first windows (key and text set), and stretches of removed windows (number set).
FOUND = "key long, shard long, doc long, tie long, start long, text binary, number long"
NAMES = [c.split()[0] for c in FOUND.split(", ")]


def found_rows(key, shard, doc, tie, start, text, number) -> pa.RecordBatch:
    n = len(start)
    none = lambda kind: pa.nulls(n, kind)
    columns = [none(pa.int64()) if key is None else pa.array(key, pa.int64()), pa.array(shard, pa.int64()), doc, tie, pa.array(start, pa.int64()), none(pa.binary()) if text is None else text, none(pa.int64()) if number is None else pa.array(number, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=NAMES)


def described(docs: DataFrame, width: int) -> DataFrame:
    """One row a document: its runs' keys, and their spans, start << SPAN_BITS | number; `again`: keys that repeat inside a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = strings(b.column(2))
            keys, spans, again = [], [], []
            for i in range(b.num_rows):
                found: list[list[np.ndarray]] = [[], [], []]
                for at in range(int(offsets[i]), int(offsets[i + 1]), PIECE):
                    k, start, number, more = runs(data[at : min(at + PIECE + width - 1, offsets[i + 1])], width)
                    for into, x in zip(found, (k, (start + at - offsets[i] << SPAN_BITS) | number, more), strict=True):
                        into.append(x)
                for into, x, kind in zip((keys, spans, again), found, (U, np.int64, U), strict=True):
                    into.append(np.concatenate(x) if x else np.zeros(0, kind))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(list_array(x, pa.int64()) for x in (keys, spans, again))], names=["doc", "tie", "keys", "spans", "again"])

    return docs.mapInArrow(run, "doc long, tie long, keys array<long>, spans array<long>, again array<long>")


def segments(spans: DataFrame) -> DataFrame:
    """(doc, tie, starts, numbers): a document's suspect windows as few, long stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, numbers = [], []
            for row in b.column(2):
                span = np.unique(np.asarray(row.values))
                start = span >> SPAN_BITS
                until = start + (span & ((1 << SPAN_BITS) - 1))
                fresh = np.flatnonzero(np.concatenate(([True], start[1:] > until[:-1])))
                starts.append(start[fresh])
                numbers.append(until[np.append(fresh[1:] - 1, len(span) - 1)] - start[fresh])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), list_array(starts, pa.int64()), list_array(numbers, pa.int64())], names=["doc", "tie", "starts", "numbers"])

    return spans.mapInArrow(run, "doc long, tie long, starts array<long>, numbers array<long>")


def sharded(suspects: DataFrame, width: int) -> DataFrame:
    """Of texts (doc, tie, text) with their suspect stretches: removed windows (key null) and the first of each window in its shard."""

    def shard(number: int, parts: list[tuple[int, int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        parts.sort(key=lambda p: (p[0] is not None, *p[:3]))
        size = np.array([len(p[3]) for p in parts], np.int32)  # a shard has few bytes, so 32 bits hold its places
        text, base = np.concatenate([p[3] for p in parts]), np.cumsum(size, dtype=np.int32) - size
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), size)
        inner = np.arange(len(text), dtype=np.int32) - base[owner]
        sa = suffix_array(text, width)
        apart = np.cumsum(common_prefixes(text, sa) < width, dtype=np.int32)
        valid = (inner + width <= size[owner])[sa]
        sa, apart = sa[valid], apart[valid]
        # equal windows lie together, by position; rows that repeat a document count as the same place
        lead = np.concatenate(([True], apart[1:] != apart[:-1]))
        del apart, valid
        first = sa[leaders(lead)]
        ids = np.cumsum([0] + [a[:2] != b[:2] for a, b in zip(parts[1:], parts[:-1], strict=True)], dtype=np.int32)
        place = np.array([p[2] for p in parts])[owner] + inner
        later = (ids[owner[sa]] != ids[owner[first]]) | (place[sa] != place[first])
        gone, kept = np.zeros(len(text), bool), np.zeros(len(text), bool)
        gone[sa[later]] = True
        kept[sa[lead]] = True
        del sa, first, lead, later
        doc, tie = (pa.array([p[k] for p in parts], pa.int64()) for k in (0, 1))
        cuts = inner == 0
        del inner
        at, n = stretches(gone, cuts)
        yield found_rows(None, np.full(len(at), number), doc.take(pa.array(owner[at])), tie.take(pa.array(owner[at])), place[at], None, n)
        key = sliding(gram_hashes(text, GRAM), width - GRAM + 1, np.minimum)
        cuts[1 : len(key)] |= key[1:] != key[:-1]
        at, n = stretches(kept, cuts)
        key = key[at].view(np.int64)
        yield found_rows(key, np.full(len(at), number), doc.take(pa.array(owner[at])), tie.take(pa.array(owner[at])), place[at], sliced(text, at, n + width - 1), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, parts, held = TaskContext.get().partitionId() << 32, [], 0
        most = (1 << SHARD_BITS) - 2
        for b in batches:
            data, offsets = strings(b.column(2))
            for i, (doc, tie, starts, numbers) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True)):
                for x, windows in zip(starts, numbers, strict=True):
                    while windows:
                        take = min(windows, max(most - held - width + 1, 0))
                        if take < min(windows, 1000):
                            yield from shard(number, parts)
                            number, parts, held = number + 1, [], 0
                            continue
                        parts.append((doc, tie, x, data[offsets[i] + x : offsets[i] + x + take + width - 1].copy()))
                        held += take + width - 1
                        x, windows = x + take, windows - take
        if parts:
            yield from shard(number, parts)

    return suspects.mapInArrow(run, FOUND)


def absorbed(text: np.ndarray, a: tuple, b: tuple, width: int) -> tuple[tuple, np.ndarray, np.ndarray]:
    """Two ascending lists (hash, place in text) of distinct windows made one: windows of b that a has are found by binary search and left out, and returned with those they equal."""
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    hit = a[0][at] == b[0]
    here = np.argsort(b[1][hit])
    x, y = b[1][hit][here], a[1][at[hit]][here]
    # confirmed byte by byte: windows that go on from the pair before need only their last byte compared
    chain = np.concatenate(([False], (np.diff(x) == 1) & (np.diff(y) == 1))) if len(x) else np.zeros(0, bool)
    same = text[x + width - 1] == text[y + width - 1]
    windows = np.lib.stride_tricks.sliding_window_view(text, width)
    same[~chain] = (windows[x[~chain]] == windows[y[~chain]]).all(axis=1)
    new = ~hit
    if not same.all():  # two passages have the same hash: both stay
        same = (windows[x] == windows[y]).all(axis=1)
        new[np.flatnonzero(hit)[here][~same]] = True
        x, y = x[same], y[same]
    into = np.searchsorted(a[0], b[0][new])
    return (np.insert(a[0], into, b[0][new]), np.insert(a[1], into, b[1][new])), x, y


def windows_of(rows: DataFrame, width: int) -> DataFrame:
    """Every window of runs as a run of its own, keyed by its own hash: equal windows still meet, and a key that many different windows share is dealt apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = strings(b.column(NAMES.index("text")))
            shard, doc, tie, start = (b.column(NAMES.index(c)) for c in ("shard", "doc", "tie", "start"))

            def parted(parts: list[tuple[int, int, int]]) -> pa.RecordBatch:
                own, first, n = (np.array(c) for c in zip(*parts))
                row = np.repeat(own, n)
                inner = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(row))
                at = offsets[row] + inner
                low, high = int(at.min()), int(at.max()) + width
                key = span_hash(prefix_hash(data[low:high]), at - low, at - low + width).view(np.int64)
                of = pa.array(row)
                return found_rows(key, shard.take(of), doc.take(of), tie.take(of), start.take(of).to_numpy() + inner, sliced(data, at, np.full(len(at), width)), None)

            parts, held = [], 0
            for r, n in enumerate((np.diff(offsets) - width + 1).tolist()):
                for first in range(0, n, EACH_WINDOWS):
                    parts.append((r, first, min(EACH_WINDOWS, n - first)))
                    held += parts[-1][2]
                    if held >= EACH_WINDOWS:
                        yield parted(parts)
                        parts, held = [], 0
            if parts:
                yield parted(parts)

    return rows.select(*NAMES).mapInArrow(run, FOUND)


def merged(firsts: DataFrame, width: int) -> DataFrame:
    """Windows (key null) that an earlier document's run of the same key has."""
    spark = firsts.sparkSession
    dealt = firsts.repartition(partitions(spark), "key").sortWithinPartitions("key", F.col("doc").asc_nulls_first(), "tie", "start")

    def chunk(t: pa.Table) -> Iterator[pa.RecordBatch]:
        data, offsets = strings(t.column("text").cast(pa.large_binary()).combine_chunks())
        change = np.ones(len(t), bool)
        change[1:] = np.diff(t.column("key").to_numpy()) != 0
        n = np.diff(offsets) - width + 1
        row = np.repeat(np.arange(len(t)), n)
        opens = np.zeros(len(row), bool)
        opens[np.cumsum(n) - n] = True
        window = offsets[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
        # groups of one key hold equal windows too; the lists below hold all groups, so a group is part of the hash
        hashes = span_hashes(data, window, window + width) ^ mix(np.cumsum(change).astype(U))[row]
        # one list for each place in a group: a tournament in which the earlier list takes in the later
        place = np.arange(len(t)) - np.maximum.accumulate(np.where(change, np.arange(len(t)), 0))
        turn = np.argsort(place[row], kind="stable")
        lists = []
        for own in np.split(turn, np.flatnonzero(np.diff(place[row][turn])) + 1):
            own = own[np.argsort(hashes[own])]
            lists.append((hashes[own], window[own]))
        lost = np.zeros(len(data) + 1, bool)
        # rows that repeat a document may lie in several shards: the same window of it is no repeat
        begin, ids = t.column("start").to_numpy(), [t.column(c).combine_chunks() for c in ("doc", "tie")]
        other = np.zeros(len(t), bool)
        for c in (ids[0].is_null(), ids[0].fill_null(0), ids[1]):
            other[1:] |= np.diff(c.to_numpy(zero_copy_only=False)) != 0
        document = np.cumsum(other | change)
        while len(lists) > 1:
            made = [absorbed(data, a, b, width) for a, b in zip(lists[::2], lists[1::2])]
            for _, x, y in made:
                r, q = (np.searchsorted(offsets, p, "right") - 1 for p in (x, y))
                same = (document[r] == document[q]) & (begin[r] + x - offsets[r] == begin[q] + y - offsets[q])
                lost[x[~same]] = True
            lists = [m[0] for m in made] + lists[len(made) * 2 :]
        start = begin[row] + window - offsets[row]
        at, m = stretches(lost[window], opens)
        shard, doc, tie = (t.column(c).combine_chunks().take(pa.array(row[at])) for c in ("shard", "doc", "tie"))
        yield found_rows(None, shard, doc, tie, start[at], None, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(NAMES.index("key")).to_numpy()
            # whole keys only: this batch's last key may go on
            cut = int(np.searchsorted(keys, keys[-1]))
            if size + b.nbytes >= MERGE_BYTES and (cut or held and last != keys[-1]):
                yield from chunk(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held, size, b = [], 0, pa.Table.from_batches([b.slice(cut)]).combine_chunks().to_batches()[0]
            held.append(b)
            size += b.nbytes
            last = keys[-1]
        if held:
            yield from chunk(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, FOUND)


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc, tie, start, number): stretches of windows of `width` bytes that also start earlier in the corpus.

    Earlier: a smaller id, or the same document and a smaller start; null ids come first. Different
    texts of one id are ordered by `tie`, a hash of the text; rows that repeat id and text are one
    document. Null text is empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"))
    table = stage(described(rows.where(F.octet_length("text") >= width), width), "suffix-runs")
    counts = table.select(F.explode(F.concat("keys", "again")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    common = stage(counts.where("n > 1"), "suffix-keys")
    each = table.select("doc", "tie", F.explode(F.arrays_zip("keys", "spans")).alias("r")).select("doc", "tie", F.col("r.keys").alias("key"), F.col("r.spans").alias("span"))
    spans = each.join(common.select("key"), "key", "left_semi").groupBy("doc", "tie").agg(F.collect_list("span").alias("spans"))
    spans = stage(segments(spans), "suffix-spans")
    unstage(table)
    spans = small(spans).withColumnsRenamed({"doc": "_doc", "tie": "_tie"})
    suspects = rows.join(spans, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("tie") == F.col("_tie"))).select("doc", "tie", "text", "starts", "numbers")
    local = stage(sharded(suspects, width), "suffix-shards")
    firsts = local.where("key IS NOT NULL").drop("number")
    # keys with more runs than a task should get are dealt by their windows
    hot = stage(common.where(F.col("n") > HOT).select("key"), "suffix-hot")
    if hot.isEmpty():
        rest = firsts
    else:
        marked = firsts.join(small(hot).withColumn("hot", F.lit(True)), "key", "left")
        rest = marked.where("hot IS NULL").drop("hot").unionByName(windows_of(marked.where("hot").withColumn("number", F.lit(None).cast("long")), width).drop("number"))
    return local.where("key IS NULL").unionByName(merged(rest.withColumn("number", F.lit(None).cast("long")).select(*NAMES), width)).select("doc", "tie", "start", "number")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and `kept`, binary, with keep_text) of every document.

    Every byte covered by a window of repeated_windows() is removed. Texts shorter than `width`
    lose nothing. Rows that repeat id and text are one document and report alike. An empty table
    gives no rows. Other columns are not read.
    """
    found = repeated_windows(docs, id_col, text_col, width).groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "number")).alias("cut"))
    found = small(stage(found, "suffix-cut"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie_"), text.alias("text"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("tie_") == F.col("tie")), "left").select("doc_id", "text", "cut")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = strings(b.column(1))
            cuts = b.column(2)
            starts, numbers = (cuts.flatten().field(k).to_numpy() for k in (0, 1))
            at = np.concatenate(([0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(cuts), 0).to_numpy())))
            out: list[list] = [[] for _ in range(5)]
            for i in range(b.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                step = np.zeros(len(own) + 1, np.int64)
                x, n = starts[at[i] : at[i + 1]], numbers[at[i] : at[i + 1]]
                np.add.at(step, x, 1)
                np.add.at(step, x + n + width - 1, -1)
                lost = np.cumsum(step[:-1]) > 0
                kept = own[~lost].tobytes()
                spans = int((lost & ~np.concatenate(([False], lost[:-1]))[: len(lost)]).sum())
                for c, v in zip(out, (len(own), int(lost.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None), strict=True):
                    c.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = rows.mapInArrow(run, schema)
    return out if keep_text else out.drop("kept")
