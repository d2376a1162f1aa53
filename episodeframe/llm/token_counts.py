"""Count-only Viterbi: how many unigram pieces a text takes, without building them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentencepieces import SPACE, default_model, fields

#: A character that no piece covers costs the worst score and this much more (the libraries' constant).
UNKNOWN_PENALTY = 10.0
#: Bytes of words whose results a worker keeps, about (100 a word beside its characters); the table is emptied when full.
MEMO_BYTES = 100 << 20
#: Longer words hardly come again and are not kept.
LONGEST = 64


def vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """(piece, score) by id from a SentencePiece model file. BPE scores are merge ranks and serve as unigram scores."""
    import struct

    with open(path or default_model(), "rb") as f:
        found = [dict(fields(v)) for n, v in fields(f.read()) if n == 1]
    return [(p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0) for p in found]


class Counter:
    """Best segmentation's score and piece count, by the tokenizers library's unigram rules.

    As in that library, every entry of the vocabulary is a string that a text may hold, control and
    byte pieces included: `</s>` or `<0x41>` written out in a text matches the entry of that name
    (the sentencepiece library would not match those). Every vocabulary match comes from one Aho-Corasick pass. At each end the candidates are tried by
    ascending start and only a strictly better score replaces one, so ties go to the longest last
    piece. A character without a one-character piece may stand alone as unknown; a run of unknowns
    counts as one piece, or as its bytes if the vocabulary has all byte pieces.

    Where no piece has a blank mark behind another character, a path always cuts before a blank
    mark, so a text's best path is its words' best paths; with whole-number scores their
    sums are exact, and each distinct word is solved once. Other vocabularies run over whole texts.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        worst = min((s for _, s in pieces), default=0.0)
        for piece, score in pieces:
            if piece and not self.automaton.exists(piece):
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = worst - UNKNOWN_PENALTY
        names = {p for p, _ in pieces}
        self.singles = {p for p in names if len(p) == 1}
        self.bytes = all(f"<0x{i:02X}>" in names for i in range(256))
        cuts = re.compile(f"[^{SPACE}]{SPACE}")
        self.by_word = all(float(s).is_integer() and not cuts.search(p) for p, s in pieces)
        self.memo: dict[str, tuple[int, float]] = {}
        self.held = 0

    def solve(self, text: str) -> tuple[int, float]:
        """(pieces, score) of a normalised text."""
        if not self.singles.issuperset(text):
            return self.solve_unknown(text)
        n = len(text)
        top, count = [-inf] * (n + 1), [0] * (n + 1)
        top[0] = 0.0
        # matches come by ascending end, and longest first at each end
        for last, (length, s) in self.automaton.iter(text):
            end = last + 1
            start = end - length
            s += top[start]
            if s > top[end]:
                top[end] = s
                count[end] = count[start] + 1
        return count[n], top[n]

    def solve_unknown(self, text: str) -> tuple[int, float]:
        """solve() where some character has no piece of its own."""
        n = len(text)
        score: list[float | None] = [0.0] + [None] * n
        count, run = [0] * (n + 1), [False] * (n + 1)
        single = [False] * n
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(text):
            matches[end].append(found)
            if found[0] == 1:
                single[end] = True
        for end in range(n):
            best, at = None, 0
            for length, s in sorted(matches[end], key=lambda m: -m[0]):
                total = s + score[end + 1 - length]
                if best is None or total > best:
                    best, at = total, end + 1 - length
            if not single[end] and (best is None or self.unknown + score[end] > best):
                score[end + 1] = self.unknown + score[end]
                run[end + 1] = True
                count[end + 1] = count[end] + (len(text[end].encode()) if self.bytes else 0 if run[end] else 1)
            else:
                score[end + 1], count[end + 1] = best, count[at] + 1
        return count[n], score[n]

    def count(self, text: str) -> tuple[int, float]:
        """(pieces, score) of a text: blanks become marks and one is put in front; the empty text has none."""
        if not text:
            return 0, 0.0
        if not self.by_word:
            return self.solve(SPACE + text.replace(" ", SPACE))
        parts = text.split(" ")
        if "" in parts or SPACE in text:
            parts = [p for p in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]
            parts = [p[1:] for p in parts]
        memo = self.memo
        if self.held > MEMO_BYTES:
            memo.clear()
            self.held = 0
        long = []
        for p in set(parts):
            if p not in memo:
                memo[p] = self.solve(SPACE + p)
                if len(p) > LONGEST:
                    long.append(p)
                else:
                    self.held += 100 + len(p)
        pieces, score = 0, 0.0
        for p in parts:
            c, s = memo[p]
            pieces += c
            score += s
        for p in long:
            del memo[p]
        return pieces, score


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, n_pieces, score of every whole text. Null text is empty (0 pieces, score 0); repeated rows give a row each."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = counter(path)
        for b in batches:
            found = [it.count(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "n_pieces", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_pieces long, score double")
