"""Headers of tensor files, whatever the files' length."""

import json

import pytest

from episodeframe.sources import readers


def put(path, tensors, length):
    head = json.dumps({"__metadata__": {"a": "b"}} | {k: {"dtype": "F16", "shape": [1], "data_offsets": list(o)} for k, o in tensors.items()}).encode()
    with path.open("wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        f.truncate(8 + len(head) + length)  # a hole: no block of it is on disk


def test_a_file_of_three_gigabytes(spark, tmp_path):
    gb = 1 << 30
    put(tmp_path / "large.safetensors", {"b": (gb, 3 * gb), "a": (0, gb)}, 3 * gb)
    put(tmp_path / "gap.safetensors", {"a": (0, 10), "b": (12, 20)}, 20)
    put(tmp_path / "long.safetensors", {"a": (0, 10)}, 11)
    put(tmp_path / "none.safetensors", {}, 0)
    got = sorted((r._file, r.tensor, r.begin, r.end, r.contiguous) for r in readers.tensor_headers(spark, str(tmp_path)).collect())
    assert got == [("gap.safetensors", "a", 0, 10, False), ("gap.safetensors", "b", 12, 20, False), ("large.safetensors", "a", 0, gb, True), ("large.safetensors", "b", gb, 3 * gb, True), ("long.safetensors", "a", 0, 10, False)]


def test_a_header_beyond_the_file(spark, tmp_path):
    (tmp_path / "x").write_bytes((50).to_bytes(8, "little") + b"{}")
    with pytest.raises(Exception, match="a header of 50 bytes"):
        readers.tensor_headers(spark, str(tmp_path)).collect()
