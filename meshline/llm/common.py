"""Shared plumbing: shared-folder staging, Arrow helpers, hashing of ids."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker looks at together.
BLOCK_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (only where that is unset and the driver is the one executor) a new local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return str(held.get())
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="meshline-")
        spark.sparkContext.setCheckpointDir(root)
    return str(root)


class Stage:
    """Tables written to the shared folder, which cut lineage and outlive lost executors.

    A table is read back lazily, so a caller that returns a frame over it
    leaves it in place; tables that only fed later tables are dropped.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, tag: str) -> str:
        return f"{self.base}/{tag}"

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(tag))
        # Files of finished shuffles go when the driver collects their handles; else they would fill the disks meanwhile.
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(self.path(tag))

    def drop(self, *tags: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for tag in tags:
            path = jvm.org.apache.hadoop.fs.Path(self.path(tag))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; dealt out evenly where its files have fewer parts than there are cores, as small tables in one file do."""
    found, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return found if found.rdd.getNumPartitions() >= cores else found.repartition(cores)


def spare(name: str, columns: list[str]) -> str:
    """``name``, made longer until none of ``columns`` has it: for internal columns beside those of a caller."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_found(docs: DataFrame, found: DataFrame, column: str) -> tuple[DataFrame, str]:
    """Every row of ``docs`` with ``column`` of ``found`` for its doc_id (null where there is none), and the name it has there."""
    name, key = spare(column, docs.columns), spare("_id", [*docs.columns, column])
    right = found.select(F.col("doc_id").alias(key), F.col(column).alias(name)).hint("merge")
    return docs.join(right, F.col("doc_id") == F.col(key), "left").drop(key), name


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null ids fall in bucket 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a column's values have about ``limit`` bytes together; one longer value stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
        total, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def bytes_of(texts: pa.Array) -> list[bytes]:
    """Each text as UTF-8, null as empty."""
    return [x or b"" for x in texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """word -> random signed 64-bit integer; emptied when it holds ``most`` words, so memory is bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = int.from_bytes(xxhash.xxh3_64_digest(word), "little", signed=True)
        if len(self) >= self.most:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words)).view(np.uint64)


def windows64(words: np.ndarray, size: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` consecutive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, seed, dtype=np.uint64)
    factor = np.uint64(0xD6E8FEB86659FD93)
    for k in range(size):
        out *= factor
        out += words[k : k + n]
        out ^= out >> np.uint64(29)
    return mix64(out)
