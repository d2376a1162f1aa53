"""Benchmark decontamination: documents are streamed through a generalised suffix automaton of the test items.

The automaton is made once of all items' words and goes to every task. In a task, arrays find the
stretches of a document whose neighbouring words stand together somewhere in the items; a match can't reach
beyond such a stretch, so only these, word by word, follow the automaton.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import fresh
from .kernels import LOWER, chunks, strings, term_spans

WINDOW = 10
#: Words of all items together that an automaton is made of: some 40 bytes a word in every task, ten times that while the driver makes it.
MAX_WORDS = 2_000_000

FOUND = "struct<n_words: long, n_hit: long, items: array<string>, spans: array<struct<first: long, last: long, start: long, end: long>>>"


class Automaton:
    """All stretches of the items' words. State 0 is the empty one.

    `length` and `link`: the longest stretch of a state and the state of its longest suffix in another one.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.length, self.link = array("l", [0]), array("l", [-1])
        after: list[dict[int, int]] = [{}]
        texts = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        for _, text in texts:
            last = 0
            for word in text:
                last = self._extend(after, last, word)
        n = max(1, len(self.ids))
        steps = sorted((state * n + word, to) for state, row in enumerate(after) for word, to in row.items())
        self.keys, self.to = array("q", [k for k, _ in steps]), array("l", [t for _, t in steps])
        self.least = min((min(window, len(t)) for _, t in texts), default=window)
        self._mark(texts)
        words = np.array(list(self.ids), object)
        flat = np.frombuffer(b" ".join(words), np.uint8) if len(words) else np.zeros(0, np.uint8)
        hashes = term_spans(flat, np.array([0, len(flat)]))[3]
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.pairs = np.unique(np.array([a * n + b for _, t in texts for a, b in zip(t, t[1:])], np.int64))

    def _state(self, after: list[dict[int, int]], length: int, link: int, row: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        after.append(row)
        return len(after) - 1

    def _split(self, after: list[dict[int, int]], state: int, word: int) -> int:
        """The state of `state`'s longest stretch and word, of its own if need be."""
        to = after[state][word]
        if self.length[to] == self.length[state] + 1:
            return to
        copy = self._state(after, self.length[state] + 1, self.link[to], dict(after[to]))
        self.link[to] = copy
        while state >= 0 and after[state].get(word) == to:
            after[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, after: list[dict[int, int]], last: int, word: int) -> int:
        if word in after[last]:
            return self._split(after, last, word)
        new = self._state(after, self.length[last] + 1, 0, {})
        while last >= 0 and word not in after[last]:
            after[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(after, last, word)
        return new

    def _mark(self, texts: list[tuple[str, list[int]]]) -> None:
        """`whole`: the state that has a state's last `window` words; `items` of such states; `short`: items that are shorter than a window
        and a suffix of a state's stretches, with their lengths."""
        by_length = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.whole, self.items, self.short = array("l", [0] * len(self.length)), {}, {}
        for s in by_length:
            if self.length[s] >= self.window:
                self.whole[s] = s if self.length[self.link[s]] < self.window else self.whole[self.link[s]]
        for name, text in texts:
            state = size = 0
            for word in text:
                state, size = self.step(state, size, word)
                if size >= self.window:
                    self.items.setdefault(self.whole[state], set()).add(name)
            if len(text) < self.window:
                self.short.setdefault(state, set()).add((len(text), name))
        for s in by_length[1:]:
            if up := self.short.get(self.link[s]):
                self.short[s] = self.short.get(s, set()) | up

    def step(self, state: int, size: int, word: int) -> tuple[int, int]:
        """The state and length of the longest match that ends with word."""
        n = len(self.ids)
        while True:
            key = state * n + word
            at = bisect_left(self.keys, key)
            if at < len(self.keys) and self.keys[at] == key:
                return self.to[at], size + 1
            state = self.link[state]
            if state < 0:
                return 0, 0
            size = self.length[state]

    def stretches(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, end, first) of a chunk's words, and (low, high) of the word ranges that a window may lie in."""
        start, end, first, hashes = term_spans(data, offsets)
        if not len(hashes) or not len(self.hashes):
            return start, end, first, np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        word = np.where(known, self.order[at], 0)
        joined = np.zeros(len(word), bool)
        both = np.flatnonzero(known[1:] & known[:-1]) + 1
        if len(self.pairs):
            pair = word[both - 1] * len(self.ids) + word[both]
            place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[both] = self.pairs[place] == pair
        joined[first[first < len(word)]] = False
        low = np.flatnonzero(known & ~joined)
        ends = np.append(~joined[1:], True) & known
        high = np.flatnonzero(ends) + 1
        long = high - low >= self.least
        return start, end, first, low[long], high[long]

    def follow(self, words: Iterator[bytes], base: int) -> tuple[list[list[int]], set[str]]:
        """Merged spans [first, last) of the words inside windows, counted from base, and the items whose windows they are."""
        spans, items, windows, state, size = [], set(), set(), 0, 0
        for place, raw in enumerate(words, base + 1):
            word = self.ids.get(raw)
            if word is None:
                state = size = 0
                continue
            state, size = self.step(state, size, word)
            reach = 0
            if size >= self.window:
                reach = self.window
                windows.add(self.whole[state])
            for length, name in self.short.get(state, ()):
                if length <= size:
                    reach = max(reach, length)
                    items.add(name)
            if reach:
                low = place - reach
                while spans and low <= spans[-1][1]:
                    low = min(low, spans.pop()[0])
                spans.append([low, place])
        return spans, items.union(*(self.items[w] for w in windows))

    def search(self, column: pa.Array) -> pa.Array:
        """FOUND for each text of a column."""
        data, offsets = strings(column)
        out = []
        for i, j in chunks(offsets):
            part = LOWER[data[offsets[i] : offsets[j]]]
            start, end, first, low, high = self.stretches(part, offsets[i : j + 1] - offsets[i])
            found = [{"n_words": int(n), "n_hit": 0, "items": set(), "spans": []} for n in np.diff(first)]
            for a, b, doc in zip(low.tolist(), high.tolist(), (np.searchsorted(first, low, "right") - 1).tolist(), strict=True):
                spans, items = self.follow((part[start[x] : end[x]].tobytes() for x in range(a, b)), a)
                row, own, at = found[doc], int(first[doc]), int(offsets[i + doc] - offsets[i])
                row["items"] |= items
                row["n_hit"] += sum(y - x for x, y in spans)
                for x, y in spans:
                    if row["spans"] and row["spans"][-1]["last"] == x - own:  # goes on where another stretch ended
                        row["spans"][-1] |= {"last": y - own, "end": int(end[y - 1]) - at}
                    else:
                        row["spans"].append({"first": x - own, "last": y - own, "start": int(start[x]) - at, "end": int(end[y - 1]) - at})
            out += [row | {"items": sorted(row["items"])} for row in found]
        kinds = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "start", "end")])))]
        return pa.array(out, pa.struct(kinds))


def automaton(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> Automaton:
    """The automaton of a benchmark of at most MAX_WORDS words; a larger one is an error before anything is collected."""
    size = items.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    if size > 2 * MAX_WORDS:  # words may be that many; count them
        lower = F.regexp_replace(F.coalesce(text_col, F.lit("")), "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+", " ")
        if (count := items.agg(F.sum(F.size(F.split(F.trim(lower), " ")))).first()[0]) > MAX_WORDS:
            raise ValueError(f"the items have {count} words; an automaton takes {MAX_WORDS}")
    rows = []
    for name, text in items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.encode(F.coalesce(text_col, F.lit("")), "UTF-8")).toLocalIterator():
        data = LOWER[np.frombuffer(text, np.uint8)]
        start, end, _, _ = term_spans(data, np.array([0, len(data)]))
        rows.append((name, [data[a:b].tobytes() for a, b in zip(start, end, strict=True)]))
    return Automaton(rows, window)


def found_in(docs: DataFrame, items: DataFrame, window: int, text_col: str) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(automaton(items, window))

    @F.arrow_udf(FOUND)
    def search(text: pa.Array) -> pa.Array:
        return shared.value.search(text)

    return search(F.col(text_col))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: `<id_col>, n_words, n_hit, n_items, items, spans, contaminated`.

    Words are [0-9a-z and all beyond ASCII]+ after lower-casing A-Z. A window is `window` consecutive words of an item, or
    all words of an item that has fewer. `n_hit` counts the words inside any occurrence of a window, `items` are
    the ids (as text, sorted) of the items with a window that occurs, `spans` the maximal runs of hit words: first and last
    count words, start and end bytes of the UTF-8 text; the end is exclusive.

    A null text has no words. Repeated documents each give a row, null ids too. Items without words have no
    window; equal texts under several ids are several items, rows with one id are one, and a null id counts as 'null'. Without documents there
    are no rows, without items no hits. Columns beyond those named are not read. No shuffle: a map over the documents.
    """
    at = docs.select(F.col(id_col).alias("id"), found_in(docs, items, window, text_col).alias("m"))
    return at.select(F.col("id").alias(id_col), "m.n_words", "m.n_hit", F.size("m.items").cast("long").alias("n_items"), "m.items", "m.spans", (F.col("m.n_hit") > 0).alias("contaminated"))


@F.arrow_udf(StringType())
def without(text: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without the bytes of the spans."""
    out = []
    for t, cut in zip(text.cast(pa.binary()).to_pylist(), spans.to_pylist(), strict=True):
        if t is not None and cut:
            edges = [0, *(x for s in cut for x in (s["start"], s["end"])), len(t)]
            t = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2]))
        out.append(t if t is None else t.decode())
    return pa.array(out, pa.string())


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs with every span of hit words cut from its text, and without the documents that hits cover to more than `coverage` of their words.

    Columns, repeated rows, null texts and documents without hits stay as they are; see contamination() for what a hit is.
    """
    mark = fresh(docs, "_found")
    found = docs.withColumn(mark, found_in(docs, items, window, text_col))
    kept = found.where(F.col(f"{mark}.n_hit") <= coverage * F.col(f"{mark}.n_words"))
    return kept.withColumn(text_col, F.when(F.col(f"{mark}.n_hit") > 0, without(F.col(text_col), F.col(f"{mark}.spans"))).otherwise(F.col(text_col))).drop(mark)
