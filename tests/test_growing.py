"""Files that grow between the triggers of a stream."""

import json

import pytest

from episodeframe.sources import growing
from episodeframe.streaming import journal


def run(spark, folder, tmp_path, **options):
    rows = growing.complete_lines(spark, str(folder), **options)
    q = rows.writeStream.format("parquet").option("path", str(tmp_path / "kept")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    found = spark.read.schema("file string, offset long, line string, closed boolean").parquet(str(tmp_path / "kept")).collect()
    return sorted((r.file, r.offset, r.line, r.closed) for r in found)


def append(path, text):
    with path.open("a", encoding="utf-8") as f:
        f.write(text)


def test_three_appends_over_restarts(spark, tmp_path):
    """Each run is a new query from the checkpoint."""
    folder = tmp_path / "j"
    folder.mkdir()
    append(folder / "a", "one\n\ntw")
    append(folder / ".hidden", "no\n")
    assert run(spark, folder, tmp_path) == [("a", 0, "one", False), ("a", 4, "", False)]
    append(folder / "a", "ö\nthree")
    append(folder / "b", "x")
    first = [("a", 0, "one", False), ("a", 4, "", False), ("a", 5, "twö", False)]
    assert run(spark, folder, tmp_path) == first
    assert run(spark, folder, tmp_path) == first
    append(folder / "a", "\nEND\nafter\n")
    append(folder / "b", "\ny\n")
    all_ = sorted(first + [("a", 10, "three", False), ("a", 16, None, True), ("b", 0, "x", False), ("b", 2, "y", False)], key=lambda r: r[:2])
    assert run(spark, folder, tmp_path) == all_
    append(folder / "a", "more\n")
    append(folder / "b", "END")
    assert run(spark, folder, tmp_path) == all_


def test_growth_under_a_running_query(spark, tmp_path):
    folder = tmp_path / "j"
    folder.mkdir()
    append(folder / "a", "0\nhal")
    q = growing.complete_lines(spark, str(folder)).writeStream.format("memory").queryName("grown").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
        assert [r.line for r in spark.table("grown").collect()] == ["0"]
        append(folder / "a", "f\n1\n")
        q.processAllAvailable()
        append(folder / "a", "END\n")
        q.processAllAvailable()
        assert [(r.line, r.closed) for r in spark.table("grown").orderBy("offset").collect()] == [("0", False), ("half", False), ("1", False), (None, True)]
    finally:
        q.stop()


@pytest.mark.parametrize("size", [1, 2, 7, 64])
def test_spans_of_a_long_file(tmp_path, monkeypatch, size):
    """However a file is cut into spans and blocks, each line comes once."""
    text = "".join(f"{'x' * (i % 5)}{i}\n" for i in range(40)) + "END\nno\n"
    append(tmp_path / "a", text)
    monkeypatch.setattr(growing, "PART_BYTES", size)
    monkeypatch.setattr(growing, "BLOCK", 3)
    reader = growing.BatchReader({"path": str(tmp_path)})
    rows = [r for span in reader.partitions() for r in reader.read(span)]
    want, at = [], 0
    for line in text.split("\n")[:41]:
        want.append(("a", at, None if line == "END" else line, line == "END"))
        at += len(line) + 1
    assert rows == want


def test_batch_pattern_and_shrunk_file(spark, tmp_path):
    append(tmp_path / "a.jsonl", "one\nSTOP\nafter\n")
    append(tmp_path / "b.txt", "two\n")
    found = growing.complete_lines(spark, str(tmp_path), stream=False, end="STOP", pattern="*.jsonl").collect()
    assert sorted((r.file, r.offset, r.line, r.closed) for r in found) == [("a.jsonl", 0, "one", False), ("a.jsonl", 4, None, True)]
    reader = growing.StreamReader({"path": str(tmp_path)})
    reader.latestOffset()
    (tmp_path / "b.txt").write_text("x")
    with pytest.raises(ValueError, match="append-only"):
        reader.latestOffset()


def test_journal_follows(spark, tmp_path):
    folder = tmp_path / "j"
    folder.mkdir()
    event = lambda k: json.dumps({"source_step": k, "metrics": {"a/b": k / 2, "plain": 1}, "time": 1.0}) + "\n"
    append(folder / "m.jsonl", event(1) + event(2)[:9])
    q = journal.read_journal(spark, str(folder)).writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
        append(folder / "m.jsonl", event(2)[9:] + "broken\nEND\n" + event(3))
        q.processAllAvailable()
        assert sorted((r.source_step, r.key, r.value) for r in spark.table("followed").collect()) == [(1, "a/b", 0.5), (2, "a/b", 1.0)]
    finally:
        q.stop()
