"""Many polylines at once in numpy: segments, distances along them, samples and parts.

Work is linear in points plus what is asked for: distances along a line are
running sums, and a distance finds its segment by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from meshline.functions.geometry import EPSILON


class Polylines:
    """The lines of a column of points; segments of no length are left out."""

    def __init__(self, pts: pa.Array):
        sizes = np.asarray(pts.value_lengths().fill_null(0), dtype=np.int64)
        flat = pts.flatten()
        self.n, self.sizes, self.first = len(sizes), sizes, np.cumsum(sizes) - sizes
        self.x, self.y = (np.asarray(flat.field(c), dtype=np.float64) for c in ("x", "y"))
        row = np.repeat(np.arange(self.n), sizes)
        a = np.flatnonzero(row[1:] == row[:-1])
        dx, dy = self.x[a + 1] - self.x[a], self.y[a + 1] - self.y[a]
        length = np.sqrt(dx * dx + dy * dy)
        some = length >= EPSILON
        a, dx, dy, self.length = a[some], dx[some], dy[some], length[some]
        self.row, self.x0, self.y0, self.x1, self.y1 = row[a], self.x[a], self.y[a], self.x[a + 1], self.y[a + 1]
        self.tx, self.ty = dx / self.length, dy / self.length
        self.edge = np.searchsorted(self.row, np.arange(self.n + 1))
        self.end = np.empty(len(a))
        for b, e in zip(self.edge[:-1].tolist(), self.edge[1:].tolist(), strict=True):
            np.cumsum(self.length[b:e], out=self.end[b:e])
        self.start = self.end - self.length
        self.start[1:] = np.where(self.row[1:] == self.row[:-1], self.end[:-1], 0.0)
        self.start[:1] = 0.0
        self.total = np.zeros(self.n)
        full = self.edge[1:] > self.edge[:-1]
        self.total[full] = self.end[self.edge[1:][full] - 1]
        self.some = full

    def at(self, row: np.ndarray, d: np.ndarray, side: str = "left") -> np.ndarray:
        """The segment of each distance ``d`` along line ``row`` (rows in order): the first that reaches it, the last beyond the end. All rows have segments."""
        out = np.empty(len(row), dtype=np.int64)
        if not len(row):
            return out
        change = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        for a, b in zip(change.tolist(), [*change[1:].tolist(), len(row)], strict=True):
            s, e = self.edge[row[a]], self.edge[row[a] + 1]
            out[a:b] = s + np.minimum(np.searchsorted(self.end[s:e], d[a:b], side), e - s - 1)
        return out

    def on(self, s: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The points of segments at distances along their lines."""
        t = (d - self.start[s]) / self.length[s]
        return self.x0[s] + (self.x1[s] - self.x0[s]) * t, self.y0[s] + (self.y1[s] - self.y0[s]) * t

    def sample(self, row: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """x, y and unit vector at distances along lines; beyond an end, the end itself."""
        s = self.at(row, d)
        return *self.on(s, np.minimum(d, self.start[s] + self.length[s])), self.tx[s], self.ty[s]

    def parts(self, row: np.ndarray, a: np.ndarray, b: np.ndarray, least: float, by_axis: bool = True) -> list[np.ndarray | None]:
        """The parts of lines between two distances, without overlaps or steps shorter than ``least``; None if nothing is left.

        ``by_axis``: a step is as long as its x or its y, the longer of both,
        so that a slanting overlap of ``least`` may still go. Otherwise every
        such overlap stays from end to end.
        """
        low, high = self.at(row, a, "right"), self.at(row, b, "left")
        out: list[np.ndarray | None] = []
        for i, j, p, q in zip(low.tolist(), high.tolist(), a.tolist(), b.tolist(), strict=True):
            s = np.arange(i, j + 1)
            begin, end = np.maximum(p, self.start[s]), np.minimum(q, self.start[s] + self.length[s])
            s, begin, end = (v[end - begin >= least] for v in (s, begin, end))
            line = np.stack([np.stack(self.on(s, begin), axis=1), np.stack(self.on(s, end), axis=1)], axis=1).reshape(-1, 2).tolist()
            kept = line[:1]
            for k, (x, y) in enumerate(line[1:], 1):
                dx, dy = abs(kept[-1][0] - x), abs(kept[-1][1] - y)
                if dx >= least or dy >= least if by_axis else k % 2 or dx * dx + dy * dy >= least * least:
                    kept.append([x, y])
            out.append(np.array(kept) if q - p >= least and len(kept) >= 2 else None)
        return out

    def places(self) -> np.ndarray:
        """The place of each segment among those of its line, from 1 for the longest, the earlier of equals first."""
        order = np.lexsort((np.arange(len(self.row)), -self.length, self.row))
        out = np.empty(len(order), dtype=np.int32)
        out[order] = np.arange(len(order)) - self.edge[self.row[order]] + 1
        return out


def segments(features: DataFrame) -> DataFrame:
    """A row for each segment of ``features``, with the number of the segment, its length, the distance reached and its place by length (n, len, reached, place) instead of pts."""
    kept = [c for c in features.columns if c != "pts"]
    schema = T.StructType([*features.select(*kept).schema.fields, T.StructField("n", T.IntegerType()), T.StructField("len", T.DoubleType()), T.StructField("reached", T.DoubleType()), T.StructField("place", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = Polylines(batch.column("pts"))
            take = pa.array(p.row)
            number = (np.arange(len(p.row)) - p.edge[p.row] + 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in kept), pa.array(number), pa.array(p.length), pa.array(p.end), pa.array(p.places())], [*kept, "n", "len", "reached", "place"])

    return features.select(*kept, "pts").mapInArrow(run, schema)
