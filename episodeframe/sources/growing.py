"""Append-only text files that grow while they are read: a data source of complete lines with byte offsets per file."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .storage import opened

BLOCK = 1 << 20
#: Bytes of a file's new lines that one task reads, about.
PART_BYTES = 64 << 20


@dataclass
class Span(InputPartition):
    """Lines of a file that start in [start, stop); `first`: start is a line's start. `over`: where the end line ends, if there is one."""

    name: str
    start: int
    stop: int
    first: bool
    over: int | None


class Files:
    """The files of a folder, and how far their complete lines reach."""

    def __init__(self, options: dict):
        self.folder, self.pattern, self.end = options["path"], options.get("pattern", "*"), options.get("end", "END").encode()
        self.known: dict[str, list] = {}

    def reach(self, system: fs.FileSystem, path: str, size: int, start: int) -> list:
        """[position after the last complete line, whether that is the end line], reading on from a line's start; nothing after an end line counts."""
        place, rest = start, b""
        with system.open_input_file(path) as f:
            f.seek(start)
            while f.tell() < size and (block := f.read(min(BLOCK, size - f.tell()))):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    place += len(line) + 1
                    if line == self.end:
                        return [place, True]
        return [place, False]

    def latest(self) -> dict[str, list]:
        system, root = opened(self.folder)
        for found in system.get_file_info(fs.FileSelector(root)):
            name = found.base_name
            if not found.is_file or name[0] in "._" or not fnmatch(name, self.pattern):
                continue
            place, closed = self.known.get(name, (0, False))
            if found.size < place:
                raise ValueError(f"{name} has {found.size} bytes, {place} were read: it is not append-only")
            if not closed and found.size > place:
                self.known[name] = self.reach(system, found.path, found.size, place)
        return dict(self.known)

    def spans(self, start: dict, end: dict) -> list[Span]:
        out = []
        for name, (stop, closed) in sorted(end.items()):
            low = start.get(name, (0, False))[0]
            for a in range(low, stop, PART_BYTES):
                out.append(Span(name, a, min(a + PART_BYTES, stop), a == low, stop if closed else None))
        return out

    def lines(self, span: Span) -> Iterator[tuple]:
        system, root = opened(self.folder)
        with system.open_input_file(f"{root}/{span.name}") as f:
            place, rest = span.start, b""
            if not span.first:  # the line that began before is another span's
                place -= 1
            f.seek(place)
            skip = not span.first
            while place < span.stop and (block := f.read(BLOCK)):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    if place >= span.stop:
                        return
                    at, place = place, place + len(line) + 1
                    if skip:
                        skip = False
                    elif place == span.over and line == self.end:
                        yield span.name, at, None, True
                    else:
                        yield span.name, at, line.decode("utf-8", "replace"), False


class StreamReader(Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.latest()

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self.known = {name: own for name, own in end.items()} | {n: own for n, own in self.known.items() if own[0] > end.get(n, (0,))[0]}
        return self.spans(start, end)

    def read(self, partition: Span) -> Iterator[tuple]:
        return self.lines(partition)


class BatchReader(Files, DataSourceReader):
    def partitions(self) -> list[Span]:
        return self.spans({}, self.latest())

    def read(self, partition: Span) -> Iterator[tuple]:
        return self.lines(partition)


class GrowingLines(DataSource):
    """Options: path (a folder), pattern of file names (`*`), end (the line that closes a file, `END`)."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "file string, offset long, line string, closed boolean"

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)


def rewrite(lines: DataFrame, path: str, order: list[Column], rest: str = "") -> None:
    """Files of a folder from lines (name, line), each written by one task line by line, in order, and `rest` after the last; a file that is there is replaced."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(path)
        name, out = None, None
        for batch in batches:
            for own, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != name:
                    if out:
                        out.write(rest.encode())
                        out.close()
                    name, out = own, system.open_output_stream(f"{root}/{own}", buffer_size=BLOCK)
                out.write(f"{line}\n".encode())
        if out:
            out.write(rest.encode())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.string())], ["done"])

    system, root = opened(path)
    system.create_dir(root)
    keys = [c.alias(f"_{i}") for i, c in enumerate(order)]
    dealt = lines.select("name", "line", *keys).repartition("name").sortWithinPartitions("name", *(f"_{i}" for i in range(len(keys))))
    dealt.select("name", "line").mapInArrow(write, "done string").write.format("noop").mode("overwrite").save()


def complete_lines(spark: SparkSession, path: str, stream: bool = True, end: str = "END", pattern: str = "*") -> DataFrame:
    """(file, offset, line, closed) of the complete lines of append-only files in a folder, by the byte at which each starts.

    What follows the last line feed may still grow and waits. The end line closes its file: it comes as a row without a line,
    with `closed`, and what is written after it is no data. As a stream, lines that are appended between triggers come out once, new
    files too, and a restart from the checkpoint goes on at the byte offsets in it. A file that has shrunk is an error.
    Only new bytes are looked at for line ends (after a restart, once, all of them); long stretches are read by several tasks.
    """
    spark.dataSource.register(GrowingLines)
    reader = spark.readStream if stream else spark.read
    return reader.format("growing_lines").option("end", end).option("pattern", pattern).load(path)
