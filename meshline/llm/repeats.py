"""What substring dedup and suffix-array dedup share: anchors of windows and classes of runs.

A window of ``size`` units (words or bytes) has as its anchor the place, among
the shorter grams inside it, whose hash is least (the leftmost of equals).
Equal windows have equal anchors at equal distances, so two windows can only
be equal where their anchors' grams are. Neighbouring windows mostly share an
anchor: a run of windows is one row, not one per window. Runs whose whole span
of units is equal are a class; in a class of several every window repeats.
Only one member per class, of grams that have several classes, is looked at
window by window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshline.llm.common import Stage

#: A run: hashes of its anchor's gram and of its whole span (128 bits together), document, first window, number of windows.
RUNS = "h long, s long, doc_id long, start int, n int"
#: Low bits of a key that hold a place; hashes are compared by the bits above.
_PLACE = 24


def least_in_windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every ``width`` consecutive hashes the index of the least, the leftmost of equals."""
    n = len(hashes)
    if n < width:
        return np.empty(0, dtype=np.int64)
    if n > 1 << _PLACE:
        step = (1 << _PLACE) - width
        return np.concatenate([least_in_windows(hashes[k : k + step + width - 1], width) + k for k in range(0, n - width + 1, step)])
    low = np.uint64((1 << _PLACE) - 1)
    keys = (hashes & ~low) | np.arange(n, dtype=np.uint64)
    filled = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
    filled[:n] = keys
    rows = filled.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return (np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & low).astype(np.int64)


def runs(grams: np.ndarray, width: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor) of every run, from the hashes of a document's grams; ``width`` grams to a window; ``among``: which windows count."""
    at = least_in_windows(grams, width)
    if not len(at):
        return at, at, at
    change = np.concatenate([[True], at[1:] != at[:-1], [True]])
    if among is None:
        first = np.flatnonzero(change[:-1])
        return first, np.diff(np.append(first, len(at))), at[first]
    held = np.concatenate([[False], among, [False]])
    first = np.flatnonzero(among & (change[:-1] | ~held[:-2]))
    last = np.flatnonzero(among & (change[1:] | ~held[2:]))
    return first, last - first + 1, at[first]


def batch(columns: list, names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def repeated(found: DataFrame, stage: Stage, tag: str = "") -> DataFrame:
    """The runs whose anchor's gram occurs more than once.

    Counts are summed per task before they are dealt out, so no gram's runs
    meet in one task, and staged, so that the join that brings them back to
    all runs can be split where one gram is hot.
    """
    held = stage.write(found, f"runs{tag}")
    grams = stage.write(held.groupBy("h").count().where("count > 1").select("h"), f"repeated{tag}")
    some = stage.write(held.join(grams.hint("merge"), "h", "left_semi"), f"some{tag}")
    stage.drop(f"runs{tag}", f"repeated{tag}")
    return some


def classes(some: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """From repeated runs: those of classes of several with their class's first member (``d``, ``at``); and the first member of each class (``several``: classes of its gram, more than one)."""
    kinds = stage.write(some.groupBy("h", "s").agg(F.count("*").alias("count"), F.min(F.struct("doc_id", "start", "n")).alias("first")), "classes")
    several = stage.write(kinds.groupBy("h").agg(F.count("*").alias("several")).where("several > 1"), "several")
    first = stage.write(kinds.join(several.hint("merge"), "h").select("h", "count", "several", "first.*"), "first")
    many = stage.write(kinds.where("count > 1").select("h", "s", F.col("first.doc_id").alias("d"), F.col("first.start").alias("at")), "many")
    whole = stage.write(some.join(many.hint("merge"), ["h", "s"]).select("doc_id", "start", "n", "d", "at"), "whole")
    stage.drop("classes", "several", "many")
    return whole, first
