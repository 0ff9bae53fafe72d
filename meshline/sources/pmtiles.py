"""Tile archives as a Spark data source, read by byte ranges.

The header and the root directory are two small reads. Each leaf directory is
a partition; an archive without leaves is cut into runs of its root's entries.
A partition reads its own part of the directory and then its tiles, several
neighbours with one read.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from meshline.sinks.pmtiles import Entry, read_directory, tile_of

SCHEMA = "z int, x int, y int, data binary"
#: Entries of a partition where there are no leaves; bytes of one read.
ENTRIES, READ_BYTES = 2048, 4 << 20


@dataclass
class Part(InputPartition):
    leaf: tuple[int, int] | None
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _open(self):
        files, path = pyarrow.fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")
        return files.open_input_file(path)

    @staticmethod
    def _head(f) -> dict[str, int]:
        data = f.read_at(127, 0)
        if data[:8] != b"PMTiles\x03":
            raise ValueError("not a PMTiles archive of version 3")
        return dict(zip(("root", "root_bytes", "meta", "meta_bytes", "leaves", "leaf_bytes", "tiles", "tile_bytes"), struct.unpack_from("<8Q", data, 8), strict=True))

    def _root(self, f, head: dict[str, int]) -> list[Entry]:
        return read_directory(f.read_at(head["root_bytes"], head["root"]))

    def partitions(self) -> list[InputPartition]:
        with self._open() as f:
            root = self._root(f, self._head(f))
        if any(run == 0 for _, run, _, _ in root):
            return [Part((offset, size), 0, 0) for _, run, size, offset in root if run == 0]
        return [Part(None, k, k + ENTRIES) for k in range(0, max(1, len(root)), ENTRIES)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        with self._open() as f:
            head = self._head(f)
            entries = read_directory(f.read_at(part.leaf[1], head["leaves"] + part.leaf[0])) if part.leaf else self._root(f, head)[part.start : part.end]
            k = 0
            while k < len(entries):
                j, low, high = k, entries[k][3], entries[k][3] + entries[k][2]
                while j < len(entries) and low <= entries[j][3] and entries[j][3] + entries[j][2] - low <= max(READ_BYTES, high - low):
                    high = max(high, entries[j][3] + entries[j][2])
                    j += 1
                body = f.read_at(high - low, head["tiles"] + low)
                rows = [(*tile_of(i + n), gzip.decompress(body[offset - low : offset - low + size])) for i, run, size, offset in entries[k:j] for n in range(run)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["z", "x", "y", "data"])
                k = j


class ArchiveSource(DataSource):
    """``spark.read.format("pmtiles").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "pmtiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def tiles(spark: SparkSession, path: str) -> DataFrame:
    """(z, x, y, data) of every tile of an archive, unpacked."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("pmtiles").load(path)
