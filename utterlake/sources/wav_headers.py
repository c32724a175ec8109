"""A data source of WAV headers: spark.read.format("wav_headers").load(folder). Of each file only the heads of its chunks are read.

The driver lists folders down to a depth, tasks list the files of theirs; files are read by byte ranges where they lie, so
a scan of durations moves some hundred bytes a file however long its samples are.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from utterlake.sources.wav import Format, header_at

SCHEMA = "path string, length long, seconds double, rate int, channels int, bits int, read_bytes long, error string"
_ARROW = pa.schema([("path", pa.string()), ("length", pa.int64()), ("seconds", pa.float64()), ("rate", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("read_bytes", pa.int64()), ("error", pa.string())])
BATCH, AHEAD = 1024, 512


class Share(NamedTuple):
    """A folder, whether its subfolders belong to it, and which of how many shares of its files."""

    folder: str
    nested: bool
    number: int
    of: int


class Ranges:
    """Reads of a file by byte ranges, a little ahead, and counted."""

    def __init__(self, file: pa.NativeFile, length: int):
        self.file, self.length, self.start, self.held, self.read_bytes = file, length, 0, b"", 0

    def __call__(self, at: int, n: int) -> bytes:
        if not self.start <= at <= at + n <= self.start + len(self.held):
            self.start, self.held = at, self.file.read_at(min(max(n, AHEAD), max(0, self.length - at)), at)
            self.read_bytes += len(self.held)
        return self.held[at - self.start : at - self.start + n]


class WavHeaderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.depth, self.shares = options["path"], int(options.get("depth", 1)), int(options.get("shares", 4))

    def partitions(self) -> list[InputPartition]:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (pyarrow.fs.LocalFileSystem(), self.root)
        level, shares = [root], []
        for depth in range(self.depth + 1):
            below = [x.path for folder in level for x in fs.get_file_info(pyarrow.fs.FileSelector(folder)) if x.type == pyarrow.fs.FileType.Directory] if depth < self.depth else []
            shares += [Share(folder, depth == self.depth, i, self.shares) for folder in level for i in range(self.shares)]
            level = below
        return [InputPartition(tuple(s)) for s in shares]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        share = Share(*partition.value)
        fs = pyarrow.fs.FileSystem.from_uri(self.root)[0] if "://" in self.root or self.root.startswith("file:") else pyarrow.fs.LocalFileSystem()
        rows = []
        for info in fs.get_file_info(pyarrow.fs.FileSelector(share.folder, recursive=share.nested)):
            if info.type == pyarrow.fs.FileType.File and info.extension.lower() == "wav" and zlib.crc32(info.path.encode()) % share.of == share.number:
                rows.append(describe(fs, info))
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


def describe(fs: pyarrow.fs.FileSystem, info: pyarrow.fs.FileInfo) -> dict:
    """One row of the source. A file that cannot be read has an error and no seconds, it fails no task."""
    row = {"path": info.path, "length": info.size, "read_bytes": 0}
    if not info.size:
        return row | {"error": "empty"}
    try:
        with fs.open_input_file(info.path) as file:
            ranges = Ranges(file, info.size)
            try:
                found: Format = header_at(ranges, info.size)
                row |= {"seconds": found.frames / found.rate, "rate": found.rate, "channels": found.channels, "bits": found.bits}
            finally:
                row["read_bytes"] = ranges.read_bytes
    except (OSError, ValueError, struct.error, ZeroDivisionError) as problem:
        row["error"] = str(problem)
    return row


class WavHeaders(DataSource):
    """Options: depth, how many levels of folders the driver lists (1); shares, how many tasks split the files of one folder (4)."""

    @classmethod
    def name(cls) -> str:
        return "wav_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WavHeaderReader(self.options)


def wav_headers(spark: SparkSession, root: str, depth: int = 1, shares: int = 4) -> DataFrame:
    """(path, length, seconds, rate, channels, bits, read_bytes, error) of all *.wav files below root; empty and damaged files have null seconds."""
    spark.dataSource.register(WavHeaders)
    return spark.read.format("wav_headers").option("depth", depth).option("shares", shares).load(root)
