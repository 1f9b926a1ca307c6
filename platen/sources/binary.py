"""Splittable binary sources: logs of fixed-size entries and raw frames, read by ranges of bytes in many tasks.

``register(spark)`` makes the formats known. Paths are what Arrow's filesystems open
(local and shared folders, object stores); for stores that only Spark reaches there
are ``readers.read_files`` and ``readers.parse_binlog``. Only the columns of the
schema that is given are decoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

BINLOG = "ts long, event_id int, cpu int, arg0 long, arg1 long, arg2 long"
#: An entry of the log, little-endian: fixed values of the format.
ENTRY = np.dtype([("ts", "<i8"), ("event_id", "<i4"), ("cpu", "<i4"), ("arg0", "<i8"), ("arg1", "<i8"), ("arg2", "<i8")])
LINES = "path string, y0 long, n_lines long, width long, stride long, data binary"
#: Bytes of a partition and of what a task holds at a time.
SPLIT, STEP = 1 << 25, 1 << 20


@dataclass
class Range(InputPartition):
    path: str
    start: int  # the first entry or line
    count: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_below(path: str) -> list[fs.FileInfo]:
    """The file, or the files of a folder whose names don't begin with _ or ."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.is_file]
    return sorted((f for f in found if f.base_name[0] not in "_."), key=lambda f: f.path)


def ranges(path: str, unit: int, split: int) -> list[Range]:
    """Ranges of whole units of about ``split`` bytes; an incomplete last unit of a file is left out."""
    most = max(1, split // unit)
    return [Range(f.path, at, min(most, f.size // unit - at)) for f in files_below(path) for at in range(0, f.size // unit, most)]


def pieces(path: str, part: Range, unit: int) -> Iterator[tuple[int, bytes]]:
    """(first unit, bytes) of a range, about STEP bytes at a time."""
    system, _ = opened(path)
    step = max(1, STEP // unit)
    with system.open_input_file(part.path) as f:
        for at in range(part.start, part.start + part.count, step):
            n = min(step, part.start + part.count - at)
            yield at, f.read_at(n * unit, at * unit)


class BinlogSource(DataSource):
    """``binlog``: options path and split (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "binlog"

    def schema(self) -> str:
        return BINLOG

    def reader(self, schema: StructType) -> DataSourceReader:
        return BinlogReader(self.options, schema.names)


class BinlogReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        unknown = set(columns) - set(ENTRY.names)
        if unknown:
            raise ValueError(f"not in the log: {sorted(unknown)}")
        self.path, self.split, self.columns = options["path"], int(options.get("split", SPLIT)), columns

    def partitions(self) -> list[Range]:
        return ranges(self.path, ENTRY.itemsize, self.split) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for _, data in pieces(self.path, partition, ENTRY.itemsize) if partition.count else ():
            entries = np.frombuffer(data, ENTRY)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(entries[c])) for c in self.columns], names=self.columns)


class RawLines(DataSource):
    """``rgb24``: raw frames as rows of whole lines; options path, width, stride (0: packed), split."""

    @classmethod
    def name(cls) -> str:
        return "rgb24"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> DataSourceReader:
        return RawReader(self.options)


class RawReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split, self.width = options["path"], int(options.get("split", SPLIT)), int(options["width"])
        self.stride = int(options.get("stride", 0)) or self.width * 3
        if self.width <= 0 or self.stride < self.width * 3:
            raise ValueError("a line needs a width and at least three bytes a pixel")

    def partitions(self) -> list[Range]:
        return ranges(self.path, self.stride, self.split) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for at, data in pieces(self.path, partition, self.stride) if partition.count else ():
            row = {"path": partition.path, "y0": at, "n_lines": len(data) // self.stride, "width": self.width, "stride": self.stride, "data": data}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("path", pa.string()), ("y0", pa.int64()), ("n_lines", pa.int64()), ("width", pa.int64()), ("stride", pa.int64()), ("data", pa.binary())]))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BinlogSource)
    spark.dataSource.register(RawLines)


def read_binlog(spark: SparkSession, path: str, columns: str = BINLOG, split: int = SPLIT) -> DataFrame:
    """The entries of all logs below a path, as ``readers.parse_binlog`` gives them, but in partitions of ``split`` bytes."""
    register(spark)
    return spark.read.format("binlog").schema(columns).option("path", path).option("split", split).load()


def read_rgb24_lines(spark: SparkSession, path: str, width: int, stride: int = 0, split: int = SPLIT) -> DataFrame:
    """(path, y0, n_lines, width, stride, data) of raw frames of one width; a frame of any height is read by many tasks."""
    register(spark)
    return spark.read.format("rgb24").option("path", path).option("width", width).option("stride", stride).option("split", split).load()
