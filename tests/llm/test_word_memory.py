"""Words of a batch of many megabytes are hashed in bounded memory, and hash as they do alone."""

import tracemalloc

import numpy as np

from episodeframe.llm import kernels


def test_word_hashes_hold_a_few_bytes_for_each_byte_of_text():
    rng = np.random.default_rng(5)
    text = b" ".join(b"Word%d" % x for x in rng.integers(0, 1 << 40, 500_000))  # 8.7 MB
    data = np.frombuffer(text, np.uint8)
    kernels._powers.cache_clear()
    tracemalloc.start()
    hashes, first = kernels.word_hashes(data, np.array([0, len(data)]))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert first.tolist() == [0, 500_000]
    assert peak < 20 * len(data)  # hashed whole it is more than 50 times


def test_word_hashes_do_not_depend_on_the_chunk():
    long = b"Q" * (kernels.CHUNK + 7)
    texts = [b"One two", b"", b"  ", b"x " * (kernels.CHUNK // 2) + b"TWO", long + b" two", b"two\n" + long]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    hashes, first = kernels.word_hashes(data, offsets)
    for i, t in enumerate(texts):
        own = t.lower().split()
        assert first[i + 1] - first[i] == len(own)
        alone = {w: int(kernels.word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0]) for w in set(own)}
        assert hashes[first[i] : first[i + 1]].tolist() == [alone[w] for w in own]
