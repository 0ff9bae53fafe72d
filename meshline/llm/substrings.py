"""Substring dedup by level-wise doubling over windows of words.

Candidates are runs of neighbouring windows of the full length. At each level
a run's name is the anchor gram that all its windows contain (see
``repeats``); runs whose gram occurs once are dropped, and those that survive
are split into runs of grams twice as long, until the grams are the windows
themselves or no candidate survives. What is left are the repeated windows.
A word goes if a window over it also starts earlier, in a document of smaller
id or before in the same one.

Edge cases: a null text has no words; a text of fewer words than a window
keeps all; windows that overlap their own copy count; rows that repeat a
doc_id are one document if their texts are equal, and otherwise a place
removed in one is removed in all of them; an empty table gives no rows;
further columns may have any names. A text is held whole by one task, with
about 100 bytes a word beside it.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshline.llm import repeats
from meshline.llm.common import Stage, WordHashes, blocks, bytes_of, windows64, with_found

SIZE, LEAST = 20, 5


def lengths(size: int) -> list[int]:
    """Lengths of grams, level by level, each twice the one before or one less; the last is ``size``."""
    out = [size]
    while out[0] >= 2 * LEAST:
        out.insert(0, -(-out[0] // 2))
    return out


def _span_hashes(words: np.ndarray, first: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run's words."""
    data = memoryview(words.tobytes())
    return np.frombuffer(b"".join([xxhash.xxh3_64_digest(data[8 * f : 8 * e]) for f, e in zip(first.tolist(), (first + n + size - 1).tolist(), strict=True)]), dtype=np.int64)


def _marked(n: int, asked: list[dict]) -> np.ndarray:
    """Which of ``n`` windows the runs asked for hold."""
    edges = np.zeros(n + 1, dtype=np.int64)
    start = np.array([x["start"] for x in asked])
    end = start + np.array([x["n"] for x in asked])
    ok = end <= n
    np.add.at(edges, start[ok], 1)
    np.add.at(edges, end[ok], -1)
    return np.cumsum(edges[:n]) > 0


def _asked(docs: DataFrame, candidates: DataFrame | None) -> DataFrame:
    """(doc_id, text, asked) of the documents that have candidates; all of them, and all their windows, before the first level."""
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    if candidates is None:
        return docs.withColumn("asked", F.lit(None).cast("array<struct<start:int,n:int>>"))
    return docs.join(candidates.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("asked")).hint("merge"), "doc_id")


def _hashed(words: list[bytes], size: int, asked: list[dict] | None, known: WordHashes) -> tuple[np.ndarray, np.ndarray | None]:
    """The hashes of a text's words, only of those under the windows asked for; and which windows these are."""
    if asked is None:
        return known.of(words), None
    among = _marked(len(words) - size + 1, asked)
    under = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(among)
    under[at] += 1
    under[at + size] -= 1
    at = np.flatnonzero(np.cumsum(under[:-1]) > 0)
    out = np.zeros(len(words), dtype=np.uint64)
    out[at] = known.of([words[k] for k in at.tolist()])
    return out, among


def find_runs(asked: DataFrame, size: int, length: int, spans: bool) -> DataFrame:
    """The candidates' runs at a level of grams of ``length`` words; ``spans``: with a hash of all their words, else 0."""

    def run(batches):
        known = WordHashes()
        for block in blocks(batches):
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            for doc, raw, some in zip(block.column("doc_id").to_pylist(), bytes_of(block.column("text")), block.column("asked").to_pylist(), strict=True):
                words = raw.split()
                if len(words) < size:
                    continue
                hashes, among = _hashed(words, size, some, known)
                grams = windows64(hashes, length)
                first, n, anchor = repeats.runs(grams, size - length + 1, among)
                span = _span_hashes(hashes, first, n, size) if spans else np.zeros(len(first), dtype=np.int64)
                for column, x in zip(out, (grams[anchor].view(np.int64), span, np.full(len(first), doc), first, n), strict=True):
                    column.append(x)
            if out[0]:
                yield repeats.batch([np.concatenate(c) for c in out], repeats.RUNS)

    return asked.mapInArrow(run, repeats.RUNS)


def _windows(joined: DataFrame, size: int) -> DataFrame:
    """(a, b, doc_id, p): 128 bits of every window of the runs asked for."""
    schema = "a long, b long, doc_id long, p int"

    def run(batches):
        known = WordHashes()
        for block in blocks(batches):
            out: list[list[np.ndarray]] = [[] for _ in range(4)]
            for doc, raw, asked in zip(block.column("doc_id").to_pylist(), bytes_of(block.column("text")), block.column("asked").to_pylist(), strict=True):
                plain = raw.split()
                if len(plain) < size:
                    continue
                words, among = _hashed(plain, size, asked, known)
                p = np.arange(len(words) - size + 1)
                p = p if among is None else p[among]
                a, b = windows64(words, size)[p], windows64(words, size, 0x2545F4914F6CDD1D)[p]
                for column, x in zip(out, (a.view(np.int64), b.view(np.int64), np.full(len(p), doc), p), strict=True):
                    column.append(x)
            if out[0]:
                yield repeats.batch([np.concatenate(c) for c in out], schema)

    return joined.mapInArrow(run, schema)


def removed(docs: DataFrame, stage: Stage, size: int = SIZE) -> DataFrame:
    """(doc_id, _spans array of (start, n)): runs of windows that also start earlier."""
    spans, candidates = "doc_id long, start int, n int", None
    later = docs.sparkSession.createDataFrame([], spans)
    for length in lengths(size)[:-1]:
        candidates = repeats.repeated(find_runs(_asked(docs, candidates), size, length, length == lengths(size)[-2]), stage, str(length))
        if candidates.isEmpty():
            return later.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("_spans"))
    if candidates is not None:  # of runs that are equal word by word, one is looked at window by window
        whole, candidates = repeats.classes(candidates, stage)
        later = whole.where("doc_id > d or (doc_id = d and start > at)").select("doc_id", "start", "n")
    windows = stage.write(_windows(_asked(docs, candidates), size), "windows")
    least = stage.write(windows.groupBy("a", "b").agg(F.min(F.struct("doc_id", "p")).alias("first"), F.count("*").alias("count")).where("count > 1").select("a", "b", F.col("first.doc_id").alias("d"), F.col("first.p").alias("at")), "least")
    single = stage.write(windows.join(least.hint("merge"), ["a", "b"]).where("doc_id > d or (doc_id = d and p > at)").select("doc_id", F.col("p").alias("start"), F.lit(1).alias("n")), "single")
    stage.drop("windows", "least", "first", *(f"some{x}" for x in lengths(size)))
    found = stage.write(later.unionByName(single).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("_spans")), "spans")
    stage.drop("whole", "single")
    return found


def keep_mask(n: int, spans: list[dict] | None, size: int) -> np.ndarray:
    """Which of ``n`` units no window of the spans covers."""
    edges = np.zeros(n + 1, dtype=np.int64)
    if spans:
        start = np.array([x["start"] for x in spans])
        end = start + np.array([x["n"] for x in spans]) + size - 1
        ok = end <= n
        np.add.at(edges, start[ok], 1)
        np.add.at(edges, end[ok], -1)
    return np.cumsum(edges[:n]) == 0


def dedup(docs: DataFrame, size: int = SIZE) -> tuple[DataFrame, str]:
    """``docs`` with the runs of windows to cut: one row for each of its rows, all its columns kept; and the name of the new column."""
    stage = Stage(docs.sparkSession, "substrings")
    return with_found(docs, removed(docs, stage, size), "_spans")


def digest(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def run(batches):
        for block in blocks(batches):
            out: list[list] = [[] for _ in range(4)]
            for doc, raw, spans in zip(block.column("doc_id").to_pylist(), bytes_of(block.column("text")), block.column("_spans").to_pylist(), strict=True):
                words = raw.split()
                kept = [w for w, k in zip(words, keep_mask(len(words), spans, size).tolist(), strict=True) if k] if spans else words
                for column, x in zip(out, (doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                    column.append(x)
            yield repeats.batch(out, schema)

    return dedup(docs.select("doc_id", "text"), size)[0].select("doc_id", "text", "_spans").mapInArrow(run, schema)


_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def _rest(raw: bytes, spans: list[dict], size: int) -> bytes:
    """A text without the words the spans cover; each run of them goes with the white space after it."""
    places = [m.start() for m in _WORD.finditer(raw)]
    cut = ~keep_mask(len(places), spans, size)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], cut.view(np.int8), [0]]))).tolist()
    places.append(len(raw))
    out, start = [], 0
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        out.append(raw[start : places[a]])
        start = places[b]
    out.append(raw[start:])
    return b"".join(out)


def clean(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with repeated words cut from their texts, all its columns kept. Texts with nothing to cut stay the same, nulls too."""
    columns = docs.columns
    found, name = dedup(docs, size)

    def run(batches):
        for block in blocks(batches):
            texts = block.column("text").to_pylist()
            for k, spans in enumerate(block.column(name).to_pylist()):
                if spans and texts[k] is not None:
                    texts[k] = _rest(texts[k].encode(), spans, size).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else block.column(c) for c in columns], columns)

    return found.select(*columns, name).mapInArrow(run, docs.schema)
