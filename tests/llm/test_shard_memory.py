"""A shard's suffix array, its common prefixes and the runs cut from it take a few bytes for each byte of text."""

import tracemalloc

import numpy as np

from episodeframe.llm import suffixes


def test_a_full_shard_holds_less_than_forty_bytes_a_byte():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 117, (1 << suffixes.SHARD_BITS) - 2).astype(np.uint8)
    for a, b in rng.integers(0, len(text) - 200, (5000, 2)):
        text[b : b + 150] = text[a : a + 150].copy()
    tracemalloc.start()
    sa = suffixes.suffix_array(text)
    peaks = [tracemalloc.get_traced_memory()[1]]
    tracemalloc.reset_peak()
    prefixes = suffixes.common_prefixes(text, sa)
    peaks.append(tracemalloc.get_traced_memory()[1])
    at = np.arange(0, len(text) - 200, 35)
    tracemalloc.reset_peak()
    parts = suffixes.sliced(text, at, np.full(len(at), 134))
    peaks.append(tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert max(peaks) < 40 * len(text), peaks  # with 64-bit places it was up to 97
    assert parts[7].as_py() == text[at[7] : at[7] + 134].tobytes()
    for i in rng.integers(1, len(sa), 200):
        x, y = (text[p : p + suffixes.WIDTH].tobytes() for p in sa[i - 1 : i + 1])
        assert x <= y
        same = next((n for n, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))
        assert min(prefixes[i], suffixes.WIDTH) == same
