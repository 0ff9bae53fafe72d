"""Media columns over archive directories.

``store`` keeps payloads as members of tar archives in a shared folder. A
member is a PNG picture whose 8-bit samples are the payload, so the stored
form is lossless and compressed. ``ArchiveSource`` is a Spark data source: it
plans byte ranges over the archives of a directory, and each range streams
the members that begin in it as Arrow batches. A member is read by its own
offset and checked by its checksum; a bad or failed read is tried again for
that member alone, and one that stays bad is a row with its error, not the
end of the task.

Both sides open files with pyarrow.fs by URI, so the folder may be local or
in any store pyarrow knows. A task that runs twice writes two archives; the
committed table of members says which counts. The member table is held in
the shared folder and split by archive into side files, so the driver sees
one row per archive.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from meshline.llm.common import Stage, blocks, bytes_of

#: Payload unit, picture width, zlib level, bytes of an archive, bytes of a planned range, reads of a member.
UNIT, WIDTH, LEVEL, ARCHIVE_BYTES, RANGE_BYTES, TRIES = 576, 576, 3, 64 << 20, 8 << 20, 4
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_BLOCK = 512
SCHEMA = "doc_id long, n_bytes long, media binary, error string"


def payload(raw: bytes, unit: int = UNIT) -> bytes:
    """The bytes filled up with 255 to a positive multiple of ``unit``."""
    return raw + b"\xff" * (max(1, -(-len(raw) // unit)) * unit - len(raw))


def to_png(data: bytes, width: int = WIDTH) -> bytes:
    """Grey 8-bit samples, ``width`` to a row, no row filters. Equal payloads give equal pictures."""
    rows = np.zeros((len(data) // width, width + 1), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)

    def piece(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return _SIGNATURE + piece(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + piece(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + piece(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of a picture that ``to_png`` or any writer of unfiltered grey 8-bit rows has made."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG picture")
    at, body, shape = 8, [], None
    while at < len(media):
        (size,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("checksum of a PNG piece")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    if not shape or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not grey 8-bit samples")
    rows = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(shape[1], shape[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def features(data: bytes) -> str:
    """Size, mean, spread and entropy of the samples and a 64-bit average hash of an 8 x 8 reduction."""
    x = np.frombuffer(data, dtype=np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    edges = np.arange(64) * len(x) // 64
    cells = np.add.reduceat(x, edges, dtype=np.int64) / np.diff(np.append(edges, len(x)))
    bits = int("".join("1" if b else "0" for b in cells > cells.mean()), 2)
    return f"{WIDTH}x{len(x) // WIDTH} mean={x.mean():.3f} sd={x.std():.3f} entropy={entropy:.4f} hash={bits:016x}"


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Writes every text's payload into archives under ``folder``; returns one row per member: archive, doc_id, n_bytes, offset, size, crc."""

    def run(batches):
        files, base = _open(folder)
        files.create_dir(base, recursive=True)
        out, name, at = None, "", 0

        def close():
            nonlocal out
            if out is not None:
                out.write(b"\0" * (2 * _BLOCK))
                out.close()
                out = None

        for block in blocks(batches):
            held: list[tuple] = []
            for doc, raw in zip(block.column("doc_id").to_pylist(), bytes_of(block.column("text")), strict=True):
                media = to_png(payload(raw))
                if out is None or at > ARCHIVE_BYTES:
                    close()
                    name, at = f"{uuid.uuid4().hex}.tar", 0
                    out = files.open_output_stream(f"{base}/{name}")
                info = tarfile.TarInfo(f"{'none' if doc is None else doc}.png")
                info.size = len(media)
                out.write(info.tobuf(tarfile.USTAR_FORMAT) + media + b"\0" * (-len(media) % _BLOCK))
                held.append((name, doc, len(raw), at + _BLOCK, len(media), zlib.crc32(media)))
                at += _BLOCK + len(media) + (-len(media) % _BLOCK)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], t) for k, t in enumerate(kinds)], ["archive", "doc_id", "n_bytes", "offset", "size", "crc"])
        close()

    return docs.select("doc_id", "text").mapInArrow(run, "archive string, doc_id long, n_bytes long, offset long, size long, crc long")


@dataclass
class Range(InputPartition):
    archive: str
    members: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, members: str, range_bytes: int):
        self.folder, self.members, self.range_bytes = folder, members, range_bytes

    def partitions(self) -> list[InputPartition]:
        """Byte ranges over the archives that the member table names; one file listing, no member is read."""
        files, base = _open(self.members)
        out: list[InputPartition] = []
        archives, where = _open(self.folder)
        sizes = {f.base_name: f.size for f in archives.get_file_info(pyarrow.fs.FileSelector(where, allow_not_found=True))}
        for f in files.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True)):
            name = f.base_name.removeprefix("archive=")
            if f.type == pyarrow.fs.FileType.Directory and name in sizes:
                out += [Range(name, f"{self.members}/{f.base_name}", s, min(s + self.range_bytes, sizes[name])) for s in range(0, sizes[name], self.range_bytes)]
        return out or [Range("", "", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        files, base = _open(part.members)
        import pyarrow.dataset as ds

        inside = (ds.field("offset") >= part.start) & (ds.field("offset") < part.end)
        members = ds.dataset(base, filesystem=files, format="parquet").to_table(filter=inside).sort_by("offset").to_pylist()
        archives, where = _open(self.folder)
        rows: list[tuple] = []
        held = 0
        with archives.open_input_file(f"{where}/{part.archive}") as f:
            for m in members:
                media, error = None, None
                for attempt in range(TRIES):
                    try:
                        media = f.read_at(m["size"], m["offset"])
                        if zlib.crc32(media) != m["crc"]:
                            raise ValueError("checksum of a member")
                        error = None
                        break
                    except (OSError, ValueError) as e:
                        media, error = None, f"{part.archive}@{m['offset']}: {e}"
                        time.sleep(0.05 * 2**attempt)
                rows.append((m["doc_id"], m["n_bytes"], media, error))
                held += m["size"]
                if held > 4 << 20 or len(rows) >= 4096:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.string()))], ["doc_id", "n_bytes", "media", "error"])


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").option("members", ...).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self.options["members"], int(self.options.get("rangebytes", RANGE_BYTES)))


def open_archives(spark: SparkSession, folder: str, members: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The members (doc_id, n_bytes, media, error) of a folder of archives."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").option("members", members).option("rangebytes", str(range_bytes)).load(folder)


def describe(media: DataFrame) -> DataFrame:
    """What the stored bytes of each member give; a member that could not be read ends the query rather than go missing."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for block in blocks(batches, "media"):
            out: list[tuple] = []
            for doc, n, media, error in zip(*(block.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media", "error")), strict=True):
                if error:
                    raise RuntimeError(error)
                data = from_png(media)
                out.append((doc, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(data)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    return media.mapInArrow(run, schema)


def media_columns(docs: DataFrame) -> DataFrame:
    """Every text stored as a picture, read back by byte ranges and described.

    A null text is empty: one unit of bytes 255. Repeated rows are members of
    their own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "media")
    folder, members = stage.path("archives"), stage.path("members")
    store(docs, folder).write.partitionBy("archive").option("compression", "zstd").parquet(members)
    return describe(open_archives(spark, folder, members))
