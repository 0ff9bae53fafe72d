"""Line dedup by the suffix array over line-ID sequences, made by prefix doubling.

Every line has as its ID the place of its first occurrence. Suffixes of the
documents' ID sequences are ranked by ever longer prefixes: the rank of a
place at depth 2k comes from its ranks at depth k and at the place k lines
on, until no rank occurs twice. A rank is the first place that has it, so the
places of one rank are an interval of the suffix array whose longest common
prefix has that depth at least, and a place that is not its own rank has an
earlier copy. Only ranks that occur more than once go on, so rounds shrink.

Each place keeps the greatest depth at which it has an earlier copy. A run
whose length lies between two depths is covered by two overlapping prefixes
of the lesser one, so the prefixes of all its places together are the maximal
repeated run. Removed are later copies: of single lines of at least
``min_chars`` characters, and of runs of at least ``min_lines`` lines, short
ones included. First means the smaller doc_id, or the smaller line number in
one document.

Edge cases: a null text has no lines and stays null; an empty text is one
empty line; rows that repeat a doc_id are one document if their texts are
equal, otherwise a line removed in one is removed in all of that id; a
document whose lines all go keeps its row with an empty text here; an empty
table gives no rows; further columns may have any names. A text is held
whole by one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshline.llm.common import Stage, blocks, with_found

MIN_CHARS, MIN_LINES = 20, 3
_PLACE = ["doc_id", "i"]


def _ranked(rows: DataFrame, keys: list[str], stage: Stage, tag: str, extra: list[str]) -> DataFrame:
    """``rows`` whose keys occur more than once, with the first place (d, j) of their keys.

    Summed per task before it is dealt out, and staged, so that the join that
    brings it back to all rows can be split where one line is hot.
    """
    rows = stage.write(rows, f"{tag}-rows")
    first = rows.groupBy(*keys).agg(F.min(F.struct(*_PLACE)).alias("first"), F.count("*").alias("count")).where("count > 1").select(*keys, F.col("first.doc_id").alias("d"), F.col("first.i").alias("j"))
    found = stage.write(rows.join(stage.write(first, f"{tag}-first").hint("merge"), keys).select(*_PLACE, *extra, "d", "j"), tag)
    stage.drop(f"{tag}-rows", f"{tag}-first")
    return found


def _pairs(ranks: DataFrame, step: int) -> DataFrame:
    """The rank of each place with the rank of the place ``step`` lines on. A window holds the places of one document."""
    on = Window.partitionBy("doc_id").orderBy("i").rangeBetween(step, step)
    ahead = F.first(F.struct("d", "j")).over(on)
    return ranks.select(*_PLACE, F.col("d").alias("d1"), F.col("j").alias("j1"), ahead.alias("ahead")).where("ahead is not null").select(*_PLACE, "d1", "j1", F.col("ahead.d").alias("d2"), F.col("ahead.j").alias("j2"))


def removed(docs: DataFrame, stage: Stage, min_chars: int = MIN_CHARS, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, _gone array of (i, n)): places with an earlier copy and its length."""
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    # 128 bits of a line stand for it.
    ids = lines.select(*_PLACE, F.unhex(F.md5("line")).alias("id"), F.length("line").alias("chars"))
    later: Column = (F.col("doc_id") != F.col("d")) | (F.col("i") != F.col("j"))
    depth, ranks, keys = 1, _ranked(ids, ["id"], stage, "depth1", ["chars"]), ["d1", "j1", "d2", "j2"]
    tags = ["depth1"]
    gone = ranks.where(later & ((F.col("chars") >= min_chars) | F.lit(min_lines <= 1))).select(*_PLACE, F.lit(1).alias("n"))
    while not ranks.isEmpty():
        if depth < min_lines < 2 * depth:  # the shortest runs that go, as two overlapping prefixes
            least = _ranked(_pairs(ranks, min_lines - depth), keys, stage, f"depth{min_lines}", [])
            gone = gone.unionByName(least.where(later).select(*_PLACE, F.lit(min_lines).alias("n")))
            tags.append(f"depth{min_lines}")
        ranks, depth = _ranked(_pairs(ranks, depth), keys, stage, f"depth{2 * depth}", []), 2 * depth
        tags.append(f"depth{depth}")
        if depth >= min_lines:
            gone = gone.unionByName(ranks.where(later).select(*_PLACE, F.lit(depth).alias("n")))
    longest = gone.groupBy(*_PLACE).agg(F.max("n").alias("n"))
    found = stage.write(longest.groupBy("doc_id").agg(F.collect_list(F.struct("i", "n")).alias("_gone")), "gone")
    stage.drop(*tags)
    return found


def _rest(text: str, gone: list[dict] | None) -> tuple[list[str], int, int]:
    """Kept lines, number of removed ones and of their runs."""
    lines = text.split("\n")
    if not gone:
        return lines, 0, 0
    edges = np.zeros(len(lines) + 2, dtype=np.int64)
    start = np.array([g["i"] for g in gone]) + 1
    end = start + np.array([g["n"] for g in gone])
    ok = end <= len(lines) + 1
    np.add.at(edges, start[ok], 1)
    np.add.at(edges, end[ok], -1)
    cut = np.cumsum(edges[:-1]) > 0
    return [x for x, c in zip(lines, cut[1:].tolist(), strict=True) if not c], int(cut.sum()), int((cut[1:] & ~cut[:-1]).sum())


def digest(docs: DataFrame, min_chars: int = MIN_CHARS, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs (maximal removed runs), kept_sha256 (kept lines joined by line feeds) of every document."""
    schema = "doc_id long, n_lines long, n_removed long, n_runs long, kept_sha256 string"

    def run(batches):
        for block in blocks(batches):
            rows = []
            for doc, text, gone in zip(*(block.column(c).to_pylist() for c in ("doc_id", "text", "_gone")), strict=True):
                kept, cut, runs = ([], 0, 0) if text is None else _rest(text, gone)
                rows.append((doc, len(kept) + cut, cut, runs, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "n_lines", "n_removed", "n_runs", "kept_sha256"])

    docs = docs.select("doc_id", "text")
    found, _ = with_found(docs, removed(docs, Stage(docs.sparkSession, "lines"), min_chars, min_lines), "_gone")
    return found.mapInArrow(run, schema)


def clean(docs: DataFrame, min_chars: int = MIN_CHARS, min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with the removed lines cut from their texts, all its columns kept."""
    columns = docs.columns
    found, name = with_found(docs, removed(docs.select("doc_id", "text"), Stage(docs.sparkSession, "lines"), min_chars, min_lines), "_gone")

    def run(batches):
        for block in blocks(batches):
            texts = [text if not gone or text is None else "\n".join(_rest(text, gone)[0]) for text, gone in zip(block.column("text").to_pylist(), block.column(name).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else block.column(c) for c in columns], columns)

    return found.select(*columns, name).mapInArrow(run, docs.schema)


#: The same in SQL: lines that occur earlier, alone or as part of a window of three lines that does.
ORACLE_SQL = """
WITH l AS (SELECT doc_id, i - 1 AS i, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
w AS (SELECT doc_id, i, line, md5(line) AS a, lead(md5(line)) OVER d AS b, lead(md5(line), 2) OVER d AS c FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, i, length(line) AS chars,
  row_number() OVER (PARTITION BY a ORDER BY doc_id, i) > 1 AS one,
  c IS NOT NULL AND row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) > 1 AS three, line FROM w),
g AS (SELECT doc_id, i, line, (one AND chars >= 20) OR three OR coalesce(lag(three) OVER d, false) OR coalesce(lag(three, 2) OVER d, false) AS cut FROM f WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, cut AND NOT coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM g)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE cut)::BIGINT AS n_removed, count(*) FILTER (WHERE begins)::BIGINT AS n_runs,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT cut), '')) AS kept_sha256 FROM r GROUP BY doc_id
"""
