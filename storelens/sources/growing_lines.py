"""S4's source: line files that are still being written, as a stream.

A server appends lines while a client reads them, and a last line without its line break is
not a line yet.  Spark's text source takes a file once, whole.  This Python data source remembers
how many bytes of each file are done: a micro-batch goes up to the last line break that a
file has when the batch is planned, and what follows waits for the next one.  Files are read in
ranges of bounded size by the executors; offsets and the planned ranges are all that the driver handles,
and a repeated batch reads the same ranges again.

    spark.dataSource.register(GrowingLines)
    spark.readStream.format("growing_lines").option("path", folder).load()

Rows are ``(path, at, line)``: the file, the byte at which the line begins, and its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RANGE_BYTES = 64 << 20
_STEP = 1 << 20


@dataclass
class LineRange(InputPartition):
    """Lines of ``path`` that begin in [start, stop); ``first``: ``start`` is itself a line's beginning."""

    path: str
    start: int
    stop: int
    first: bool


def _system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _after_last_break(system, path: str, size: int) -> int:
    """The place after the last line break among the first ``size`` bytes (0 without one), read from the end."""
    with system.open_input_file(path) as f:
        end = size
        while end > 0:
            begin = max(0, end - _STEP)
            found = f.read_at(end - begin, begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            end = begin
    return 0


class GrowingLines(DataSource):
    """Options: ``path`` (a folder), ``glob`` (file names, ``*.jsonl``), ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "path string, at long, line string"

    def streamReader(self, schema) -> "GrowingLinesReader":
        return GrowingLinesReader(self.options)


class GrowingLinesReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.glob = options["path"], options.get("glob", "*.jsonl")
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, base = _system(self.folder)
        files = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        names = [(f.path, f.size) for f in files if f.is_file and fnmatch(f.base_name, self.glob)]
        done = {path: _after_last_break(system, path, size) for path, size in names}
        return {path: end for path, end in sorted(done.items()) if end}

    def partitions(self, start: dict, end: dict) -> list[LineRange]:
        out = []
        for path, stop in end.items():
            begin = start.get(path, 0)
            out += [LineRange(path, a, min(a + self.range_bytes, stop), a == begin) for a in range(begin, stop, self.range_bytes)]
        return out

    def commit(self, end: dict) -> None:
        pass

    def read(self, partition: LineRange) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.folder)
        with system.open_input_file(partition.path) as f:
            at = partition.start
            if not partition.first:  # the line that reaches into this range belongs to the one before
                at = self._next_line(f, partition.start - 1)
            held = b""
            while at < partition.stop:
                held += f.read_at(_STEP, at + len(held))
                *lines, rest = held.split(b"\n")
                places, texts = [], []
                for line in lines:
                    if at >= partition.stop:
                        break
                    places.append(at)
                    texts.append(line.decode("utf-8", "replace"))
                    at += len(line) + 1
                held = rest
                if places:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(places)), pa.array(places, pa.int64()), pa.array(texts)],
                                                     ["path", "at", "line"])

    @staticmethod
    def _next_line(f, at: int) -> int:
        """The place after the first line break at or after ``at``."""
        while True:
            some = f.read_at(_STEP, at)
            found = some.find(b"\n")
            if found >= 0 or not some:
                return at + found + 1 if some else at
            at += len(some)
