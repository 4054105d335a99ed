"""Line streams as a data source, batch and streaming: files cut into byte ranges, with limits of bytes, records and line length.

A line belongs to the range in which it begins, so ranges of one file are read apart and no line is lost or read twice.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Most bytes of a file and of a line, most records of a file. How many bytes a task reads, and a batch holds.
MOST_BYTES, MOST_LINE, MOST_RECORDS = 512 << 20, 4 << 20, 2_000_001
RANGE, AT_ONCE = 64 << 20, 8 << 20
LINES = "path string, at bigint, line string"
_ARROW = pa.schema([("path", pa.string()), ("at", pa.int64()), ("line", pa.string())])


class StreamError(ValueError):
    """A stream breaks a limit, or isn't UTF-8."""


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def _store(path: str):
    return fs.FileSystem.from_uri(re.sub("^(file:)?/+", "file:///", path))


def _files(path: str) -> list[fs.FileInfo]:
    """The files at or below ``path``, hidden ones apart, by time and name."""
    store, root = _store(path)
    found = store.get_file_info(root)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [found] if found.is_file else [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
    return sorted(files, key=lambda f: (f.mtime_ns or 0, f.path))


class _Limits:
    def __init__(self, options):
        number = lambda k, other: int(options.get(k, other))
        self.path, self.most, self.line, self.range = options["path"], number("mostBytes", MOST_BYTES), number("mostLine", MOST_LINE), number("rangeBytes", RANGE)

    def ranges(self, files) -> list[Range]:
        for f in files:
            if f.size > self.most:
                raise StreamError(f"{f.path} has {f.size} bytes; {self.most} are allowed")
        return [Range(f.path, a, min(a + self.range, f.size)) for f in files for a in range(0, f.size, self.range)]

    def read(self, part: Range):
        """Arrow batches of the lines that begin in a range. What of a line is held is bounded by its limit."""
        store, _ = _store(self.path)
        with store.open_input_file(part.path) as f:
            at, held = part.start, b""
            if at:  # the line that reaches into the range is another's
                f.seek(at - 1)
                at, held = at - 1, f.read(1)
                if held != b"\n":
                    while b"\n" not in held:
                        at, held = at + len(held), f.read(1 << 16)
                        if not held:
                            return
                    cut = held.index(b"\n") + 1
                    at, held = at + cut, held[cut:]
                else:
                    at, held = at + 1, b""
            rows, size = ([], [], []), 0
            while at < part.end:
                while b"\n" not in held:
                    more = f.read(1 << 20)
                    if not more:
                        break
                    held += more
                    if len(held) > self.line + (1 << 20) and b"\n" not in held:
                        raise StreamError(f"{part.path}: a line at byte {at} is longer than {self.line} bytes")
                if not held:
                    break
                lines = held.split(b"\n")
                ended = len(lines) > 1
                for line in lines[:-1] if ended else lines:
                    if at >= part.end:
                        break
                    if len(line) > self.line:
                        raise StreamError(f"{part.path}: a line at byte {at} is longer than {self.line} bytes")
                    place = at
                    for one in line.split(b"\r"):
                        if one:
                            try:
                                rows[2].append(one.decode())
                            except UnicodeDecodeError as e:
                                raise StreamError(f"{part.path}: the line at byte {place} isn't UTF-8") from e
                            rows[0].append(part.path), rows[1].append(place)
                            size += len(one)
                        place += len(one) + 1
                    at += len(line) + 1
                held = lines[-1] if ended else b""
                if size >= AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, _ARROW.types)], schema=_ARROW)
                    rows, size = ([], [], []), 0
                if not ended:
                    break
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, _ARROW.types)], schema=_ARROW)


class _Batch(_Limits, DataSourceReader):
    def partitions(self):
        return self.ranges(_files(self.path)) or [Range(self.path, 0, 0)]


class _Stream(_Limits, DataSourceStreamReader):
    """An offset is the time and name of the last file that was read: files must appear whole, as by a rename."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = _files(self.path)
        return {"time": files[-1].mtime_ns or 0, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        place = lambda o: (o["time"], o["path"])
        return self.ranges([f for f in _files(self.path) if place(start) < ((f.mtime_ns or 0), f.path) <= place(end)])

    def commit(self, end: dict) -> None:
        pass


class LineStreams(DataSource):
    """``spark.read.format("line_streams").load(path)``: (path, at, line) of all lines that aren't empty, ``at`` their first byte."""

    @classmethod
    def name(cls) -> str:
        return "line_streams"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def lines(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """(path, at, line) of the streams below ``path``: options mostBytes, mostLine, rangeBytes."""
    spark.dataSource.register(LineStreams)
    reader = spark.readStream if stream else spark.read
    return reader.format("line_streams").options(**options).load(path)
