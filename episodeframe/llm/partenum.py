"""N-gram Jaccard join by PartEnum signatures."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil, comb, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, small, stage, unstage
from .components import components
from .kernels import U, chunks, expand, expand_sorted, mix, shingle_sets, squeeze, squeeze_sorted, strings

#: Members of a bucket that one task compares at a time; larger buckets are compared block by block.
BLOCK = 1024
#: Shingles that a block has at most, on average: a block's sets lie in one task's memory.
BLOCK_ELEMENTS = 1 << 20
#: Buckets of a set that round one looks at, the same for similar sets as far as they share them.
FIRST_BUCKETS = 4
#: Bytes of text whose sets are made at a time (one longer document alone).
TEXT_BYTES = 1 << 19
#: Signatures that a part of the signature space gets, about.
PART_KEYS = 1 << 19
#: Signatures that a task gathers before it sends them.
SEND_KEYS = 1 << 19
#: A signature that so many sets of one sending share goes out with all of them and one witness to its part.
HOT_IN_BATCH = 8
#: What a set's membership in a bucket of strangers costs, in signatures sent.
STRANGER_COST = 50.0
#: Share of a set's elements that a stranger is taken to have too (common passages).
COMMON_SHARE = 0.3
#: Bits of a signature: two that meet only by chance cost a comparison, no more.
SIG_SHIFT = U(16)
#: Bytes of a signature.
SIG_BYTES = 6
#: Shingles are compared by the top 56 bits of their hashes.
ELEMENT_SHIFT = U(8)


@lru_cache(maxsize=8)
def bands(percent: int, upto: int) -> np.ndarray:
    """Largest size of each band: a set has its links (Jaccard >= percent / 100) in its own band and the two beside it."""
    out = [0]
    while out[-1] < upto:
        out.append((out[-1] + 1) * 100 // percent)
    return np.array(out[1:], np.int64)


def distance(percent: int, total: int | np.ndarray):
    """Largest symmetric difference of two sets of `total` elements together whose Jaccard is >= percent / 100."""
    return (100 - percent) * total // (100 + percent)


def _at_least(mean: float, n: int) -> float:
    """P(X >= n) of a Poisson variable."""
    term, below = exp(-mean), 0.0
    for i in range(n):
        below += term
        term *= mean / (i + 1)
    return max(0.0, 1.0 - below)


@lru_cache(maxsize=4096)
def layout(k: int, size: int) -> tuple[int, int, int, tuple[tuple[int, ...], ...]]:
    """(n1, n2, spare, subsets) for sets of about `size` elements that differ in at most k.

    The hash domain is cut into n1 first-level partitions of n2 second-level ones. k differences
    leave at least 1 + spare first-level partitions with at most k2 of them, n1 = k // (k2 + 1) + 1
    + spare, and in each of these some n2 - k2 of the second-level ones agree: `subsets` lists the
    choices of n2 - k2 out of n2. Of all layouts with small k2 and spare the cheapest is taken:
    signatures sent, plus the strangers a signature meets (its subset holds nothing, or only
    elements that many sets have).
    """
    best = None
    for k2 in range(min(k, 3) + 1):
        for n2 in range(k2 + 1, k2 + 4):
            each = comb(n2, k2)
            for spare in (0, 1, 2, 3, 4, 6, 8):
                n1 = k // (k2 + 1) + 1 + spare
                held = size * (n2 - k2) / (n1 * n2)
                void = exp(-held)
                left = void * _at_least(n1 * (1.0 - (1.0 - void) ** each), spare)
                cost = n1 * each * (1.0 + STRANGER_COST * (left + exp(-held * (1.0 - COMMON_SHARE)) - void))
                if best is None or cost < best[0]:
                    best = cost, n1, n2, spare, k2
    _, n1, n2, spare, k2 = best
    return n1, n2, spare, tuple(combinations(range(n2), n2 - k2))


def instances(n: int, percent: int) -> list[tuple[int, tuple]]:
    """(band, layout) of the two instances that a set of n elements takes part in: its own band's and the next one's."""
    tops = bands(percent, 1 << max(4, n.bit_length()))
    own = int(np.searchsorted(tops, n))
    after = int(tops[own + 1]) if own + 1 < len(tops) else int(tops[own] + 1) * 100 // percent
    return [(band, layout(int(distance(percent, 2 * top)), top)) for band, top in ((own, int(tops[own])), (own + 1, after))]


@lru_cache(maxsize=1 << 16)
def signature_count(n: int, percent: int) -> int:
    """Signatures that a set of n elements sends, about."""
    return sum(n1 * len(subsets) for _, (n1, _, _, subsets) in instances(n, percent)) if n else 0


def cuts(values: np.ndarray, parts: int) -> np.ndarray:
    """Positions that cut ascending 64-bit hashes into `parts` equal ranges of the hash domain."""
    bounds = np.array([(i << 64) // parts for i in range(1, parts)], U)
    return np.concatenate(([0], np.searchsorted(values, bounds), [len(values)])).astype(np.int64)


def signatures(values: np.ndarray, percent: int) -> np.ndarray:
    """PartEnum signatures of a set of ascending hashes, for its own band's instance and the next one's.

    Signatures of subsets without elements are left out where no more than `spare` first-level
    partitions have one: of the 1 + spare partitions in which two similar sets agree, at
    least one then has a signature that both send.
    """
    if not len(values):
        return np.zeros(0, U)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(mix(values ^ U(0xA5A5A5A5)), out=sums[1:])
    out = []
    for band, (n1, n2, spare, subsets) in instances(len(values), percent):
        at = cuts(values, n1 * n2)
        held = np.diff(at).reshape(n1, n2)
        part = mix((sums[at[1:]] - sums[at[:-1]]).reshape(n1, n2) + np.arange(1, n2 + 1, dtype=U))
        where = mix(np.arange(n1, dtype=U) * U(1 << 20) + U(band << 40))
        sig = np.stack([mix(part[:, list(s)].sum(axis=1, dtype=U) + where + U(j)) for j, s in enumerate(subsets)])
        void = np.stack([held[:, list(s)].sum(axis=1) == 0 for s in subsets])
        out.append(sig[~void] if void.any(axis=0).sum() <= spare else sig.ravel())
    return np.concatenate(out) >> SIG_SHIFT


def sketch(values: np.ndarray, percent: int) -> bytes:
    """A bit for each of at least four times as many hash ranges as differences allowed: differing bits never outnumber differing
    elements, and sets with little in common differ in about half of them. Packed; a power of two of ranges."""
    n = len(values)
    parts = 64
    while parts < 4 * distance(percent, 2 * n) + 4 and parts < 1 << 16:
        parts *= 2
    # a range's bit is the parity of its elements' bits, so two ranges' bits add up to that of both together
    sums = np.zeros(n + 1, np.int64)
    np.cumsum((mix(values ^ U(0x5A5A5A5A)) & U(1)).astype(np.int64), out=sums[1:])
    # the ranges are powers of two, so a value's range is its top bits
    at = np.searchsorted(values >> U(64 - parts.bit_length() + 1), np.arange(parts + 1, dtype=U))
    return np.packbits(((sums[at[1:]] - sums[at[:-1]]) & 1).astype(bool)).tobytes()


def unpacked(packed: bytes, ranges: int) -> np.ndarray:
    """The bits of a sketch brought to fewer, wider ranges: neighbours are added without carry, so equal ranges stay equal."""
    bits = np.unpackbits(np.frombuffer(packed, np.uint8))
    return np.bitwise_xor.reduce(bits.reshape(ranges, -1), axis=1) if len(bits) != ranges else bits


def node_of(values: np.ndarray) -> int:
    """A 64-bit hash of a whole set, as a signed integer."""
    return int(mix(mix(values).sum(dtype=U, keepdims=True) + U(len(values))).view(np.int64)[0])


def described(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tie (hash of the text), n_shingles, node (hash of the whole set), n_sigs of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = strings(b.column(1))
            for i, j in chunks(offsets, TEXT_BYTES):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                n = [len(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(n, pa.int64()), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([signature_count(x, percent) for x in n], pa.int64())],
                    names=["doc_id", "tie", "n_shingles", "node", "n_sigs"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    return rows.mapInArrow(run, "doc_id long, tie long, n_shingles long, node long, n_sigs long")


def sets_of(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, n, sketch, elements) of each text of a table (text); elements are the packed ascending hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = strings(b.column(0))
            for i, j in chunks(offsets, TEXT_BYTES):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s, percent) for s in sets], pa.binary()), pa.array([squeeze_sorted(s >> ELEMENT_SHIFT) for s in sets], pa.binary())],
                    names=["node", "n", "sketch", "elements"],
                )

    return texts.mapInArrow(run, "node long, n long, sketch binary, elements binary")


def members_of(texts: DataFrame, k: int, percent: int, total: int) -> DataFrame:
    """(sig, node), distinct, of the signatures that at least two different sets of a table (text) have.

    Every task sends its signatures to the part of the signature space that owns them, as packed
    ascending differences with a dictionary of the sets that have them, about seven bytes each.
    Of a signature that many sets of one sending have, the sets go to the result at once
    and one of them, as a witness, to the part; so a part stays bounded however hot a signature is.
    `total` is about the number of signatures.
    """
    parts = max(1, ceil(total / PART_KEYS))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs: list[np.ndarray] = []
        nodes: list[int] = []
        held = 0

        def packed(part: int, sig: np.ndarray, node: np.ndarray, hot: np.ndarray) -> tuple:
            names, place = np.unique(node, return_inverse=True)
            return part, squeeze_sorted(sig), names.tobytes(), squeeze(place), squeeze_sorted(hot)

        def rows() -> pa.RecordBatch:
            sig, node = np.concatenate(sigs), np.repeat(np.array(nodes, np.int64), [len(s) for s in sigs])
            order = np.lexsort((node, sig))
            sig, node = sig[order], node[order]
            fresh = np.ones(len(sig), bool)
            fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
            sig, node = sig[fresh], node[fresh]
            first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            many = np.diff(first, append=len(sig))
            lead = np.zeros(len(sig), bool)
            lead[first] = True
            hot = np.repeat(many >= HOT_IN_BATCH, many)
            out = []
            if hot.any():
                out.append(packed(parts + int(sig[0]) % parts, sig[hot], node[hot], np.zeros(0, U)))
            plain = ~hot | lead
            sig, node, hot = sig[plain], node[plain], hot[plain]
            own = ((sig >> U(16)) * U(parts) >> U(32)).astype(np.int64)  # the top 32 of 48 bits
            at = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1, [len(own)]))
            for x, y in zip(at[:-1], at[1:], strict=True):
                out.append(packed(int(own[x]), sig[x:y], node[x:y], sig[x:y][hot[x:y]]))
            types = (pa.int32(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["part", "sigs", "names", "places", "hot"])

        for b in batches:
            data, offsets = strings(b.column(0))
            for i, j in chunks(offsets, TEXT_BYTES):
                for s in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k):
                    if len(s):
                        sigs.append(signatures(s, percent))
                        nodes.append(node_of(s))
                        held += len(sigs[-1])
                        if held >= SEND_KEYS:
                            yield rows()
                            sigs, nodes, held = [], [], 0
        if nodes:
            yield rows()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(blobs: list[tuple], part: int) -> Iterator[pa.RecordBatch]:
            sig = np.concatenate([expand_sorted(b[0]) for b in blobs])
            node = np.concatenate([np.frombuffer(b[1], np.int64)[expand(b[2]).astype(np.int64)] for b in blobs])
            if part < parts:
                order = np.lexsort((node, sig))
                sig, node = sig[order], node[order]
                fresh = np.ones(len(sig), bool)
                fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
                sig, node = sig[fresh], node[fresh]
                first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
                many = np.diff(first, append=len(sig))
                shared = np.repeat(many > 1, many)
                sig, node, many = sig[shared], node[shared], many[many > 1]
                if not len(sig):
                    return
                first = np.cumsum(many) - many
                # of buckets with the same sets one is enough, unless sets have gone past this part
                key = mix(node.view(U))
                one, two = np.add.reduceat(key, first), np.add.reduceat(mix(key ^ U(0x3C3C3C3C)), first)
                hot = np.isin(sig[first], np.concatenate([expand_sorted(b[3]) for b in blobs]))
                one[hot], two[hot] = sig[first][hot], U(1)
                order = np.lexsort((many, two, one))
                again = np.zeros(len(first), bool)
                again[order[1:]] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]]) & (many[order[1:]] == many[order[:-1]])
                keep = np.repeat(~again, many)
                sig, node = sig[keep], node[keep]
            for x in range(0, len(sig), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(sig[x : x + (1 << 16)].view(np.int64)), pa.array(node[x : x + (1 << 16)])], names=["sig", "node"])

        part, blobs = None, []
        for b in batches:
            for own, *blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if blobs and (own != part or own >= parts):
                    yield from told(blobs, part)
                    blobs = []
                part = own
                blobs.append(blob)
        if blobs:
            yield from told(blobs, part)

    sent = texts.mapInArrow(send, "part int, sigs binary, names binary, places binary, hot binary")
    dealt = sent.repartition(partitions(texts.sparkSession), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(meet, "sig long, node long")


def blocked(members: DataFrame, across: bool, block: int) -> DataFrame:
    """Members (sig, node, n, ...) dealt to blocks (_i, _j, _side): a bucket beyond `block` members or BLOCK_ELEMENTS is split by
    a hash of the node; across=True makes a block of each pair of parts, otherwise each part is a block."""
    counts = members.groupBy("sig").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block)), F.ceil(F.sum("n") / F.lit(BLOCK_ELEMENTS))).cast("int").alias("_many"))
    large = stage(counts.where("_many > 1"), "join-large")
    if large.isEmpty():
        return members.withColumns({"_i": F.lit(0), "_j": F.lit(0), "_side": F.lit(0)})
    sized = members.join(small(large), "sig", "left")
    many = F.coalesce(F.col("_many"), F.lit(1))
    own = F.pmod(F.xxhash64("node"), many).cast("int")
    if not across:
        return sized.withColumns({"_i": own, "_j": own, "_side": F.lit(0)}).drop("_many")
    tasks = sized.withColumns({"_own": own, "_of": many}).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    return tasks.withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other"), "_side": (F.col("_own") > F.col("_other")).cast("int")}).drop("_own", "_other", "_of", "_many")


def by_block(rows: DataFrame, columns: list[str], work: Callable, schema: str) -> DataFrame:
    """work(key, columns as lists) for each block (sig, _i, _j) of rows sorted by node; it yields record batches."""
    dealt = rows.select("sig", "_i", "_j", "node", *columns).repartition(partitions(rows.sparkSession), "sig", "_i", "_j").sortWithinPartitions("sig", "_i", "_j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, [[] for _ in range(len(columns) + 1)]
        out, waiting = [], 0
        for batch in batches:
            for sig, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (sig, i, j) != key:
                    if len(held[0]) > 1:
                        found = work(key, held)
                        if found is not None:
                            out.append(found)
                            waiting += found.num_rows
                            if waiting > 50_000:
                                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                                out, waiting = [], 0
                    key, held = (sig, i, j), [[] for _ in range(len(columns) + 1)]
                for c, x in zip(held, row, strict=True):
                    c.append(x)
        if len(held[0]) > 1:
            found = work(key, held)
            if found is not None:
                out.append(found)
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return dealt.mapInArrow(run, schema)


def _links(node: list, pairs: list[tuple[int, int]]) -> pa.RecordBatch | None:
    if not pairs:
        return None
    return pa.RecordBatch.from_arrays([pa.array([node[x] for x, _ in pairs], pa.int64()), pa.array([node[y] for _, y in pairs], pa.int64())], names=["a", "b"])


def forest(comp: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """At most len(comp) - 1 pairs that join what near(x, others) joins; members of one comp count as joined already."""
    left, pairs = np.ones(len(comp), bool), []
    for seed in range(len(comp)):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            x = queue.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                return pairs
            own = comp[rest] == comp[x]
            hit = near(x, rest) & ~own
            pairs += [(x, y) for y in rest[hit].tolist()]
            on = rest[hit | own]
            left[on] = False
            queue.extend(on.tolist())
    return pairs


def plausible(n: np.ndarray, sketches: list[bytes], percent: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """near(x, others): the sizes allow a link and no more sketch bits differ than elements may. No link fails this."""
    width = 8 * min(map(len, sketches))
    marks = np.stack([unpacked(s, width) for s in sketches])

    def near(x: int, rest: np.ndarray) -> np.ndarray:
        fits = 100 * np.minimum(n[rest], n[x]) >= percent * np.maximum(n[rest], n[x])
        return fits & ((marks[rest] != marks[x]).sum(axis=1) <= distance(percent, n[rest] + n[x]))

    return near


def spanning(members: DataFrame, percent: int, block: int) -> DataFrame:
    """Plausible pairs (a, b), at most one less than members a block, that join each bucket's plausible members within its blocks."""

    def work(key: tuple, held: list) -> pa.RecordBatch | None:
        node, n, marks = held
        return _links(node, forest(np.arange(len(node)), plausible(np.array(n, np.int64), marks, percent)))

    return by_block(blocked(members, False, block), ["n", "sketch"], work, "a long, b long").distinct()


def packed_signatures(values: np.ndarray) -> bytes:
    """Signatures without their two upper bytes, which are none."""
    return np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES].tobytes()


def unpacked_signatures(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // SIG_BYTES, 8), np.uint8)
    out[:, :SIG_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, SIG_BYTES)
    return out.view("<i8").ravel()


def bucket_lists(members: DataFrame) -> DataFrame:
    """(node, buckets): the ascending signatures of the buckets that each node is in, packed; as many as a set has signatures at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([packed_signatures(np.asarray(x.values)) for x in b.column(1)], pa.binary())], names=["node", "buckets"])

    lists = members.groupBy("node").agg(F.array_sort(F.collect_set("sig")).alias("l"))
    return lists.mapInArrow(run, "node long, buckets binary")


def lists_below(members: DataFrame) -> DataFrame:
    """members (sig, node, ...) with `buckets`: of the packed ascending signatures of a node's buckets those below the row's own."""
    before = F.row_number().over(Window.partitionBy("node").orderBy("sig")) - 1  # as many rows as a set has signatures at most
    return members.withColumn("_at", before).join(bucket_lists(members), "node").withColumn("buckets", F.expr(f"substring(buckets, 1, {SIG_BYTES} * _at)")).drop("_at")


def unsettled(members: DataFrame, percent: int, block: int) -> DataFrame:
    """(sig, node): of the members (sig, node, n, sketch, comp) of each bucket those with a plausible partner in another comp."""

    def work(key: tuple, held: list) -> pa.RecordBatch | None:
        node, n, marks, comp = held
        comp = np.array(comp, np.int64)
        if (comp == comp[0]).all():
            return None
        near, open_, every = plausible(np.array(n, np.int64), marks, percent), np.zeros(len(node), bool), np.arange(len(node))
        for x in range(len(node) - 1):
            rest = every[x + 1 :]
            rest = rest[comp[rest] != comp[x]]
            hit = rest[near(x, rest)] if len(rest) else rest
            open_[x] |= len(hit) > 0
            open_[hit] = True
        at = np.flatnonzero(open_)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(at), pa.int64()), pa.array([node[x] for x in at], pa.int64())], names=["sig", "node"]) if len(at) else None

    return by_block(blocked(members, True, block), ["n", "sketch", "comp"], work, "sig long, node long").distinct()


def doubtful(members: DataFrame, percent: int, block: int) -> DataFrame:
    """(sig, _i, _j, _side, node, comp): of the members (sig, node, n, sketch, comp, buckets) of each block those with a plausible partner in another comp.

    A pair counts in one bucket alone, that of the least signature among those that both are in; of `buckets` those below `sig` are enough.
    """

    def work(key: tuple, held: list) -> pa.RecordBatch | None:
        node, n, marks, comp, side, buckets = held
        comp = np.array(comp, np.int64)
        if (comp == comp[0]).all():
            return None
        near, open_ = plausible(np.array(n, np.int64), marks, percent), np.zeros(len(node), bool)
        lists = [unpacked_signatures(b) for b in buckets]
        before = None
        every = np.arange(len(node))
        for x in range(len(node) - 1):
            rest = every[x + 1 :]
            rest = rest[comp[rest] != comp[x]]
            hit = rest[near(x, rest)] if len(rest) else rest
            if len(hit):
                if before is None:
                    before = shared_counts([v[v < key[0]] for v in lists]) > 0
                hit = hit[~before[x, hit]]
                open_[x] |= len(hit) > 0
                open_[hit] = True
        at = np.flatnonzero(open_)
        if not len(at):
            return None
        columns = [[key[0]] * len(at), [key[1]] * len(at), [key[2]] * len(at), [side[x] for x in at], [node[x] for x in at], comp[at]]
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["sig", "_i", "_j", "_side", "node", "comp"])

    return by_block(blocked(members, True, block), ["n", "sketch", "comp", "_side", "buckets"], work, "sig long, _i int, _j int, _side int, node long, comp long")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of membership matrices over ranges of the elements that more than one set has (as floats, exact below 2 ** 24)."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    values, place, many = np.unique(flat, return_inverse=True, return_counts=True)
    keep = many[place] > 1
    place, owner = (np.cumsum(many > 1) - 1)[place[keep]], owner[keep]
    del flat, values, keep
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = max(1, (1 << 22) // len(sets))
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, z = np.searchsorted(place, (low, low + width))
        mark = np.zeros((len(sets), min(width, int(place[z - 1]) + 1 - low)), np.float32)
        mark[owner[a:z], place[a:z] - low] = 1
        out += mark @ mark.T
    return out


def exact_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of Jaccard >= percent / 100 that join the blocks' members (comp, elements), at most one less than members a block."""

    def work(key: tuple, held: list) -> pa.RecordBatch | None:
        node, comp, elements = held
        comp = np.array(comp, np.int64)
        if (comp == comp[0]).all():
            return None
        sets = [expand_sorted(e) for e in elements]
        n = np.array([len(s) for s in sets], np.int64)
        both = shared_counts(sets)
        return _links(node, forest(comp, lambda x, rest: 100 * both[x, rest] >= percent * (n[rest] + n[x] - both[x, rest])))

    return by_block(rows, ["comp", "elements"], work, "a long, b long").distinct()


def verified(pairs: DataFrame, firsts: DataFrame, seconds: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets (node, elements; a's in firsts, b's in seconds) have Jaccard >= percent / 100, by exact intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = expand_sorted(x), expand_sorted(y)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(firsts.select(F.col("node").alias("a"), F.col("elements").alias("_x")), "a")
    two = one.join(seconds.select(F.col("node").alias("b"), F.col("elements").alias("_y")), "b")
    return two.select("a", "b", "_x", "_y").mapInArrow(run, "a long, b long")


def similarity_components(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, node, component_id of every document, for links of Jaccard >= percent / 100 on k-word shingles.

    component_id is the smallest doc_id reachable by links. Documents without words are in a
    component of their own. Null text is empty; repeated rows each give a row; null ids are
    rows like others but never a component's smallest unless alone. An empty table gives no rows.

    Equal sets are one node (the 64-bit hash of the set), and only one document of each sends
    signatures. Nodes that share a PartEnum signature are a bucket; buckets with the same members
    are kept once. Round one verifies a spanning set of the plausible pairs in a few buckets of each set. Round two
    takes the buckets that still hold several components to their members' whole sets and joins
    what is linked there by exact counts: a link is left unlooked at only inside a component that is
    already connected, and no step gives more pairs than a block has members.
    """
    with_root = rooted(docs, k, percent, id_col, text_col, block)
    least = stage(with_root.where("n_shingles > 0").groupBy("_root").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), "join-least")
    out = with_root.join(small(least), "_root", "left")
    return out.select("doc_id", "n_shingles", "node", F.when(F.col("n_shingles") > 0, F.coalesce("_least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def rooted(docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, tie, n_shingles, node, _root (the least node of the component) of every document."""
    table = stage(described(docs, k, percent, id_col, text_col), "join-docs")
    one = table.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("_of"), F.first("n_sigs").alias("n_sigs"))
    nodes = stage(one.select("node", F.col("_of.doc_id").alias("_id"), F.col("_of.tie").alias("_tie"), "n_sigs"), "join-nodes")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    text_of = lambda keys: rows.join(small(keys), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left_semi").select("text")

    total = nodes.agg(F.sum("n_sigs")).first()[0] or 0
    keys = stage(nodes.select("_id", "_tie"), "join-keys")
    found = stage(members_of(text_of(keys), k, percent, total), "join-found")
    # buckets with the same members, whatever part they met in, have the same facts
    each = found.distinct()
    facts = each.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("c"), *(F.sum(F.pmod(F.xxhash64("node", F.lit(x)), F.lit(1 << 32))).alias(f"h{x}") for x in (1, 2)))
    buckets = stage(facts.groupBy("lo", "hi", "c", "h1", "h2").agg(F.min("sig").alias("sig")).select("sig"), "join-buckets")
    members = stage(each.join(small(buckets), "sig", "left_semi"), "join-members")
    unstage(found, buckets)
    used = stage(members.select("node").distinct(), "join-used")
    ids = stage(nodes.join(small(used), "node", "left_semi").select("_id", "_tie"), "join-ids")
    made = sets_of(text_of(ids), k, percent)
    # a node has one (id, tie), so it comes twice only where rows repeat both; then, and only then, sets are shuffled to drop the repeats
    repeated = table.count() > table.select("doc_id", "tie").distinct().count()
    sets = stage(made.dropDuplicates(["node"]) if repeated else made, "join-sets")
    unstage(nodes, keys, used, ids)

    light = sets.select("node", "n", "sketch")
    # similar sets share most buckets, so the least few of each, by hash, are mostly the same ones
    least = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("sig"), "sig"))
    few = members.withColumn("_k", least).where(F.col("_k") <= FIRST_BUCKETS).drop("_k")
    pairs = stage(spanning(few.join(light, "node"), percent, block), "join-pairs")
    # of the sets only those that a pair names are moved
    named = stage(pairs.select(F.col("b").alias("node")).distinct(), "join-named")
    links = stage(verified(small(pairs), sets, sets.join(small(named), "node", "left_semi"), percent), "join-links")
    comps = stage(components(links), "join-comps")
    second = members.join(small(comps), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    mixed = stage(second.groupBy("sig").agg(F.min("comp").alias("_l"), F.max("comp").alias("_h")).where("_l <> _h").select("sig"), "join-open")
    open_ = stage(second.join(small(mixed), "sig", "left_semi"), "join-still")
    unstage(members, pairs, named, comps, mixed)
    # only members with a plausible partner elsewhere carry the list of their buckets along
    loose = stage(unsettled(open_.join(light, "node"), percent, block), "join-loose")
    left = open_.join(loose, ["sig", "node"], "left_semi")  # as many rows as open_ may have: never broadcast
    doubts = stage(doubtful(lists_below(left).join(light, "node"), percent, block), "join-doubts")
    more = stage(exact_links(small(doubts).join(sets.select("node", "elements"), "node"), percent), "join-more")
    unstage(open_, loose)
    comps = stage(components(links.union(more)), "join-comps")
    unstage(sets, links, doubts, more)
    with_root = table.select("doc_id", "tie", "n_shingles", "node").join(small(comps), "node", "left").withColumn("_root", F.coalesce("root", "node"))
    out = stage(with_root.select("doc_id", "tie", "n_shingles", "node", "_root"), "join-roots")
    unstage(table, comps)
    return out


def drop_similar(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, the smallest id; documents without words all stay.

    A document is an id and a text: rows that repeat both stay or go together, different texts of one
    id are ordered by a hash of the text, and null ids come last.
    """
    found = rooted(docs, k, percent).where("n_shingles > 0").withColumn("_none", F.col("doc_id").isNull())
    least = found.groupBy("_root").agg(F.min(F.struct("_none", "doc_id", "tie")).alias("_least"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    least = small(stage(least.select("_root", F.col("_least.doc_id").alias("_id"), F.col("_least.tie").alias("_tie")), "join-least"))
    other = ~(F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")))
    gone = found.join(least, "_root").where(other).select(F.col("doc_id").alias("_gone"), F.col("tie").alias("_gone_tie"))
    gone = small(stage(gone.distinct(), "join-gone"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]) & (F.xxhash64(docs["text"]) == gone["_gone_tie"]), "left_anti")
