"""Suffix-array dedup of bytes by two-stage sorting.

Candidates first: a window of ``size`` bytes can only be repeated where its
anchor's gram is (see ``repeats``); of runs of windows whose whole spans are
equal one is sorted. The spans of the candidates, one of each kind, are dealt
out by gram and their suffixes sorted, batch by batch:

1. suffixes smaller than their successors are sorted directly, to a depth of
   ``size`` bytes;
2. the others are induced by scanning the buckets of first bytes from the
   least on: a suffix's predecessor goes to the end of its own bucket;
3. neighbours whose common prefix has ``size`` bytes are repeated windows.

The kinds of a common gram may not fit a batch. They are sorted in batches
wherever they lie, each batch gives its different windows in order, and these
sorted runs are merged by ranges of the windows' bytes; equal neighbours in
the merged order are repeated windows too. A window that very many share is
one row of each batch.

Edge cases: a null text is empty; a text shorter than ``size`` keeps all;
a window that overlaps its own copy counts, in one document too; rows that
repeat a doc_id are documents of their own in the search, and what is removed
in one is removed in all of that id where it fits; an empty table gives no
rows; further columns may have any names. A text is held whole by one task,
with about 60 bytes a byte beside it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshline.llm import repeats
from meshline.llm.common import Stage, blocks, bytes_of, mix64, with_found
from meshline.llm.substrings import keep_mask

SIZE, GRAM = 400, 64
#: Kinds of runs of one gram that are sorted in one task; bytes sorted together.
MOST_KINDS, SORT_BYTES = 1024, 384 << 10
#: First bytes of windows by which sorted batches are merged; what the driver samples of them to set ranges.
LEAD = 24

_MULTIPLIER = 0x5851F42D4C957F2D
_VALUES = np.random.default_rng(400).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, made to the longest text so far."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 1 << 64))):
            x = np.full(max(n, 1 << 18), base, dtype=np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def rolling(b: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive bytes."""
    n = len(b)
    if n < size:
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUES[b] * up, out=sums[1:])
    return mix64((sums[size:] - sums[:-size]) * down[: n - size + 1])


def find_runs(docs: DataFrame, size: int = SIZE) -> DataFrame:
    gram = min(GRAM, size)

    def run(batches):
        for block in blocks(batches):
            out: list[list] = [[] for _ in range(4)]
            digests: list[bytes] = []
            for doc, raw in zip(block.column("doc_id").to_pylist(), bytes_of(block.column("text")), strict=True):
                if len(raw) < size:
                    continue
                grams = rolling(np.frombuffer(raw, dtype=np.uint8), gram)
                first, n, anchor = repeats.runs(grams, size - gram + 1)
                data = memoryview(raw)
                digests += [xxhash.xxh3_64_digest(data[f:e]) for f, e in zip(first.tolist(), (first + n + size - 1).tolist(), strict=True)]
                for column, x in zip(out, (grams[anchor].view(np.int64), np.full(len(first), doc), first, n), strict=True):
                    column.append(x)
            if digests:
                h, doc, first, n = (np.concatenate(c) for c in out)
                yield repeats.batch([h, np.frombuffer(b"".join(digests), dtype=np.int64), doc, first, n], repeats.RUNS)

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, repeats.RUNS)


def suffix_order(text: bytes, depth: int) -> np.ndarray:
    """All suffixes of ``text`` in the order of their first ``depth`` bytes at least, by two-stage sorting."""
    t = np.frombuffer(text, dtype=np.uint8)
    n = len(t)
    if not n:
        return np.empty(0, dtype=np.int64)
    # Smaller than the successor: the next different byte is larger. The last suffix is larger than the empty one.
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1])
    at = np.where(step != 0, np.arange(n), n)
    ahead = np.minimum.accumulate(at[::-1])[::-1]
    smaller = np.zeros(n, dtype=bool)
    smaller[ahead < n] = step[ahead[ahead < n]] > 0
    direct = np.array(sorted(np.flatnonzero(smaller).tolist(), key=lambda p: text[p : p + depth]), dtype=np.int64)
    bounds = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[-1]].append(np.array([n - 1], dtype=np.int64))
    out: list[np.ndarray] = []
    for c in range(256):
        larger = waiting[c]
        level = np.concatenate(larger) if larger else np.empty(0, dtype=np.int64)
        full = [level]
        while len(level):  # runs of one byte induce inside their own bucket
            before = level[level > 0] - 1
            level = before[(t[before] == c) & ~smaller[before]]
            full.append(level)
        bucket = np.concatenate([*full, direct[bounds[c] : bounds[c + 1]]])
        if len(bucket):
            out.append(bucket)
            before = bucket[bucket > 0] - 1
            before = before[t[before] > c]
            letters = t[before]
            order = np.argsort(letters, kind="stable")
            before, letters = before[order], letters[order]
            for x in np.unique(letters).tolist():
                a, b = np.searchsorted(letters, [x, x + 1])
                waiting[x].append(before[a:b])
        waiting[c] = []
    return np.concatenate(out)


def equal_windows(text: bytes, starts: np.ndarray, size: int) -> list[list[int]]:
    """The windows at ``starts`` in the order of the suffix array, those that are equal together."""
    known = np.zeros(len(text), dtype=bool)
    known[starts] = True
    order = suffix_order(text, size)
    order = order[known[order]]
    hashes = rolling(np.frombuffer(text, dtype=np.uint8), size)
    # Common prefixes of neighbours: bytes are compared where hashes agree.
    near = (hashes[order[1:]] == hashes[order[:-1]]).tolist()
    places = order.tolist()
    out = [places[:1]]
    for p, maybe in zip(places[1:], near, strict=True):
        if maybe and text[p : p + size] == text[out[-1][0] : out[-1][0] + size]:
            out[-1].append(p)
        else:
            out.append([p])
    return out


def repeated_windows(text: bytes, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of the windows at ``starts`` equal another of them."""
    same = np.zeros(len(text), dtype=bool)
    for group in equal_windows(text, starts, size):
        if len(group) > 1:
            same[group] = True
    return same[starts]


SEGMENTS = "h long, doc_id long, start int, n int, single int, segment binary"
SPANS = "doc_id long, start int, n int"


def _segments(joined: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for block in blocks(batches):
            out: list[list] = [[] for _ in range(6)]
            for doc, raw, asked in zip(block.column("doc_id").to_pylist(), bytes_of(block.column("text")), block.column("asked").to_pylist(), strict=True):
                for x in asked:
                    part = raw[x["start"] : x["start"] + x["n"] + size - 1]
                    if len(part) == x["n"] + size - 1:
                        for column, v in zip(out, (x["h"], doc, x["start"], x["n"], x["single"], part), strict=True):
                            column.append(v)
            yield repeats.batch(out, SEGMENTS)

    return joined.mapInArrow(run, SEGMENTS)


def _sorted_spans(segments: DataFrame, size: int) -> DataFrame:
    """The repeated windows of single runs; ``segments`` of a gram stand together."""

    def found(rows: list[tuple]) -> tuple[list, list, list]:
        text = b"".join(r[5] for r in rows)
        base = np.cumsum([0] + [len(r[5]) for r in rows[:-1]])
        starts = np.concatenate([np.arange(b, b + r[3]) for b, r in zip(base.tolist(), rows, strict=True)])
        same = repeated_windows(text, starts, size)
        out: tuple[list, list, list] = ([], [], [])
        k = 0
        for r in rows:
            mine = same[k : k + r[3]]
            k += r[3]
            if r[4] and mine.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    for column, v in zip(out, (r[1], r[2] + a, b - a), strict=True):
                        column.append(v)
        return out

    def run(batches):
        held: list[tuple] = []
        size_held, group = 0, None
        for block in batches:
            for row in zip(*(c.to_pylist() for c in block.columns), strict=True):
                if row[0] != group and size_held >= SORT_BYTES:
                    yield repeats.batch(list(found(held)), SPANS)
                    held, size_held = [], 0
                group = row[0]
                held.append(row)
                size_held += len(row[5])
        if held:
            yield repeats.batch(list(found(held)), SPANS)

    return segments.mapInArrow(run, SPANS)


def _merged_spans(segments: DataFrame, stage: Stage, size: int) -> DataFrame:
    """The same for grams whose kinds do not fit a batch: windows sorted in batches, and the batches merged."""
    schema = "w binary, doc_id long, start int, single int, count int"

    def batch(rows: list[tuple]):
        text = b"".join(r[4] for r in rows)
        base = np.cumsum([0] + [len(r[4]) for r in rows[:-1]])
        starts = np.concatenate([np.arange(b, b + r[2]) for b, r in zip(base.tolist(), rows, strict=True)])
        out: tuple[list, ...] = ([], [], [], [], [])
        # Equal windows that are all in classes of several need no place; else one row has the count and the others theirs.
        groups = equal_windows(text, starts, size)
        row = np.searchsorted(base, [p for g in groups for p in g], side="right") - 1
        k = 0
        for group in groups:
            count, mine = len(group), row[k : k + len(group)].tolist()
            k += count
            for j, (p, r) in enumerate(zip(group, mine, strict=True)):
                doc, start, _, single, _ = rows[r]
                if j == 0 or (single and count > 1):
                    for column, v in zip(out, (text[p : p + size] if j == 0 else b"", doc, start + p - int(base[r]), single, count), strict=True):
                        column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], [x.split()[0] for x in schema.split(", ")])

    def sort(batches):
        held: list[tuple] = []
        size_held = 0
        for block in batches:
            for row in zip(*(block.column(c).to_pylist() for c in ("doc_id", "start", "n", "single", "segment")), strict=True):
                held.append(row)
                size_held += len(row[4])
                if size_held >= SORT_BYTES:
                    yield batch(held)
                    held, size_held = [], 0
        if held:
            yield batch(held)

    def merge(batches):
        last, waiting = None, None  # the window before, and its place while no equal one has been seen
        for block in batches:
            out: list[tuple] = []
            for w, doc, start, single, count in zip(*(block.column(c).to_pylist() for c in ("w", "doc_id", "start", "single", "count")), strict=True):
                if w != last:
                    last, waiting = w, (doc, start, 1) if single and count == 1 else None
                elif waiting or (single and count == 1):
                    out += [x for x in (waiting, (doc, start, 1) if single and count == 1 else None) if x]
                    waiting = None
            yield repeats.batch([[r[k] for r in out] for k in range(3)], SPANS)

    windows = stage.write(segments.mapInArrow(sort, schema), "windows")
    inside = windows.where("count > 1 and single = 1").select("doc_id", "start", F.lit(1).alias("n"))
    across = windows.where("w <> X''").repartitionByRange(F.substring("w", 1, LEAD)).sortWithinPartitions("w", F.desc("count"))
    found = stage.write(inside.unionByName(across.mapInArrow(merge, SPANS)), "merged")
    stage.drop("windows")
    return found


def removed(docs: DataFrame, stage: Stage, size: int = SIZE) -> DataFrame:
    """(doc_id, _spans array of (start, n)): runs of windows that also start anywhere else."""
    whole, first = repeats.classes(repeats.repeated(find_runs(docs, size), stage), stage)
    asked = first.groupBy("doc_id").agg(F.collect_list(F.struct("h", "start", "n", (F.col("count") == 1).cast("int").alias("single"))).alias("asked"))
    wide = stage.write(first.where(F.col("several") > MOST_KINDS).select("h").distinct(), "wide")
    segments = stage.write(_segments(docs.select("doc_id", "text").join(asked.hint("merge"), "doc_id"), size), "segments")
    narrow = segments.join(wide, "h", "left_anti").repartition("h").sortWithinPartitions("h")
    spans = whole.select("doc_id", "start", "n")
    spans = spans.unionByName(stage.write(_sorted_spans(narrow, size), "sorted"))
    if not wide.isEmpty():
        spans = spans.unionByName(_merged_spans(segments.join(wide, "h", "left_semi"), stage, size))
    found = stage.write(spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("_spans")), "spans")
    stage.drop("some", "first", "wide", "segments", "whole", "sorted", "merged")
    return found


def _cut(batches, column: str, size: int):
    """(block, whole bytes, mask of kept bytes) of each row in turn, block by block."""
    for block in blocks(batches):
        raws = bytes_of(block.column("text"))
        yield block, [(raw, keep_mask(len(raw), spans, size)) for raw, spans in zip(raws, block.column(column).to_pylist(), strict=True)]


def _kept(raw: bytes, keep: np.ndarray) -> bytes:
    return raw if keep.all() else np.frombuffer(raw, dtype=np.uint8)[keep].tobytes()


def digest(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, and its remaining bytes as ``text``."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
    found, name = with_found(docs.select("doc_id", "text"), removed(docs, Stage(docs.sparkSession, "suffixes"), size), "_spans")

    def run(batches):
        for block, rows in _cut(batches, name, size):
            out: list[list] = [[] for _ in range(6)]
            for doc, (raw, keep) in zip(block.column("doc_id").to_pylist(), rows, strict=True):
                kept, cut = _kept(raw, keep), np.concatenate([[True], keep])
                for column, x in zip(out, (doc, len(raw), len(raw) - len(kept), int((~cut[1:] & cut[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")), strict=True):
                    column.append(x)
            yield repeats.batch(out, schema)

    return found.select("doc_id", "text", name).mapInArrow(run, schema)


def clean(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with the repeated bytes cut from their texts, all its columns kept; a character of which bytes are cut goes whole. Texts with nothing to cut stay the same, nulls too."""
    columns = docs.columns
    found, name = with_found(docs, removed(docs, Stage(docs.sparkSession, "suffixes"), size), "_spans")

    def run(batches):
        for block, rows in _cut(batches, name, size):
            texts = [t if t is None or keep.all() else _kept(raw, keep).decode(errors="ignore") for t, (raw, keep) in zip(block.column("text").to_pylist(), rows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else block.column(c) for c in columns], columns)

    return found.select(*columns, name).mapInArrow(run, docs.schema)
