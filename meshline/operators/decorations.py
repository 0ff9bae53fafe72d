"""Cartographic symbols along lines and on the sides of polygons.

The catalogue says, per feature code, which symbols to place; a symbol is a
generator with sizes in millimetres on the map. Features that may have symbols
are chosen by the plan; their symbols are made many features at a time in
numpy, in work linear in segments and stations, without a shuffle.

Stations are start + k * interval; the last one counts with a tolerance of a
billionth of the interval, so that it does not hang on how sums are rounded.
deco_index counts a feature's symbols that are long enough; those of bridge
ends, branches and arcs are a quarter of a metre at least at every scale that
has them, so none of these is ever left out of the count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshline.functions import names
from meshline.functions.polyline import Polylines

#: Shortest symbol in metres; figure type that suppresses symbols; margin at line ends in millimetres; steps of half a circle. Fixed values.
LEAST, SUPPRESSED, MARGIN_MM, ARC_STEPS = 0.01, 99, 0.5, 8
LARGE_SCALES, MIDDLE_SCALES = (500, 1000, 2500, 5000), (2500, 5000)


#: The sizes that each generator takes, in millimetres; right and both are yes (1) or no (0).
SIZES = {
    "boundary": ("dash", "minor", "gap", "cycle", "branch"), "ends": ("length", "both"), "ticks": ("interval", "length", "right"), "triangles": ("interval", "base", "side"),
    "pipe": ("interval", "diameter"), "semicircles": ("interval", "diameter"), "dash_dots": ("dash", "cycle", "offset"), "arcs": ("interval", "width", "height", "chord"),
}


@dataclass(frozen=True)
class Rule:
    """The symbols of one feature code; out_kinds are the geometry kinds they make."""

    code: int
    generator: str
    decoration: str
    sizes: tuple[float, ...]
    levels: tuple[int, ...] = MIDDLE_SCALES
    kind: str = "line"
    out_kinds: tuple[str, ...] = ("line",)
    figtype: int | None = None


#: Which code has which symbols. Sizes are millimetres on the map, fixed values of the map style.
CATALOGUE: tuple[Rule, ...] = (
    Rule(1101, "boundary", "major_dash", (5.0, 0.4, 1.3, 8.0, 0.5), LARGE_SCALES),
    Rule(2203, "ends", "bridge_end", (0.6, 0.0)),
    Rule(2204, "ends", "bridge_opening", (1.0, 0.0)),
    Rule(2205, "ends", "footbridge_opening", (0.6, 1.0)),
    Rule(2206, "ticks", "bridge_pier", (25.0, 1.0, 1.0)),
    Rule(2305, "ticks", "perpendicular_tick", (5.0, 0.6, 0.0)),
    Rule(2306, "triangles", "attached_triangles", (10.0, 0.8, 0.5)),
    Rule(4262, "pipe", "pipe_symbol", (3.0, 0.2), kind="polygon", out_kinds=("polygon",)),
    Rule(6102, "ticks", "perpendicular_tick_1mm", (1.0, 1.0, 0.0)),
    Rule(6110, "semicircles", "right_semicircle", (2.0, 0.4), out_kinds=("polygon",), figtype=11),
    Rule(6130, "dash_dots", "dash_segment", (2.0, 3.5, 2.75), out_kinds=("line", "point")),
    Rule(6140, "ticks", "wall_symbol", (4.0, 0.5, 1.0)),
    Rule(7105, "ticks", "right_perpendicular_tick_0_5mm", (3.0, 0.5, 1.0), LARGE_SCALES),
    Rule(7106, "ticks", "right_perpendicular_tick_0_5mm", (3.0, 0.5, 1.0), LARGE_SCALES),
    Rule(7107, "ticks", "right_perpendicular_tick_0_5mm", (3.0, 0.5, 1.0), LARGE_SCALES),
    Rule(7212, "arcs", "right_arc", (1.5, 1.5, 0.75, 0.5), LARGE_SCALES),
)
def catalogue(spark) -> DataFrame:
    """The catalogue as rows, one per code."""
    rows = [(r.code, r.kind, list(r.levels), list(r.out_kinds), r.generator, r.decoration, dict(zip(SIZES[r.generator], r.sizes, strict=True)), r.figtype) for r in CATALOGUE]
    return spark.createDataFrame(rows, "dmcode long, source_kind string, levels array<int>, out_kinds array<string>, generator string, decoration string, mm map<string,double>, only_figtype long")


def is_target(code: Column, kind: Column, level: Column, figtype: Column) -> Column:
    """Whether a feature may have symbols at all."""
    out = F.lit(False)
    for r in CATALOGUE:
        out = out | ((code == r.code) & (kind == r.kind) & level.isin(*r.levels))
    return F.coalesce(out & ~figtype.eqNullSafe(F.lit(SUPPRESSED)), F.lit(False))


def layer_keys(features: DataFrame) -> DataFrame:
    """The distinct decoration layers that the features' rules name, whether or not a symbol results."""
    rules = F.broadcast(catalogue(features.sparkSession))  # one row per rule
    hit = features.join(rules, "dmcode").where((F.col("kind") == F.col("source_kind")) & F.array_contains("levels", F.col("map_level").cast("int")) & ~F.col("dmfigtype").eqNullSafe(F.lit(SUPPRESSED)))
    return hit.select("dmcode", "kind", "zone", "map_level", F.explode("out_kinds").alias("deco_kind")).distinct()


class Pieces:
    """Pieces of symbols of many features: whose they are, their rank among its pieces, name, kind and points."""

    def __init__(self, by_axis: bool = True) -> None:
        self.by_axis = by_axis
        self.row: list[np.ndarray] = []
        self.rank: list[np.ndarray] = []
        self.label: list[np.ndarray] = []
        self.points: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.labels: list[tuple[str, str]] = []

    def _label(self, name: str, kind: str) -> int:
        if (name, kind) not in self.labels:
            self.labels.append((name, kind))
        return self.labels.index((name, kind))

    def add(self, row: np.ndarray, rank: np.ndarray, name: str, kind: str, *points: tuple[np.ndarray, np.ndarray]) -> None:
        """Pieces of equally many points, given point by point."""
        pts = np.stack([np.stack(p, axis=1) for p in points], axis=1)
        length = np.sqrt((np.diff(pts, axis=1) ** 2).sum(axis=2)).sum(axis=1)
        keep = (length >= LEAST) | (kind == "point")
        self.row.append(row[keep])
        self.rank.append(rank[keep])
        self.label.append(np.full(int(keep.sum()), self._label(name, kind)))
        self.points.append(pts[keep].reshape(-1, 2))
        self.sizes.append(np.full(int(keep.sum()), len(points)))

    def add_parts(self, lines: Polylines, row: np.ndarray, rank: np.ndarray, name: str, a: np.ndarray, b: np.ndarray) -> None:
        """Parts of the lines themselves."""
        found = lines.parts(row, a, b, LEAST, self.by_axis)
        keep = np.array([p is not None and (not self.by_axis or np.sqrt((np.diff(p, axis=0) ** 2).sum(axis=1)).sum() >= LEAST) for p in found], dtype=bool)
        kept = [p for p, k in zip(found, keep.tolist(), strict=True) if k]
        self.row.append(row[keep])
        self.rank.append(rank[keep])
        self.label.append(np.full(len(kept), self._label(name, "line")))
        self.points += kept
        self.sizes.append(np.array([len(p) for p in kept], dtype=np.int64))

    def in_order(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, index from 1, label, x and y of all points, sizes) by row and rank."""
        row, rank, label, sizes = (np.concatenate([*v, np.empty(0, dtype=np.int64)]) for v in (self.row, self.rank, self.label, self.sizes))
        points = np.concatenate([*self.points, np.empty((0, 2))])
        order = np.lexsort((rank, row))
        start = (np.cumsum(sizes) - sizes)[order]
        row, label, sizes = row[order].astype(np.int64), label[order].astype(np.int64), sizes[order].astype(np.int64)
        place = np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        first = np.searchsorted(row, row)
        return row, np.arange(len(row)) - first + 1, label, points[place.astype(np.int64)], sizes


def stations(rows: np.ndarray, start: np.ndarray, end: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which of ``rows``, k, distance) of start, start + step, ... up to end."""
    count = np.maximum(np.floor((end - start) / step + 1e-9).astype(np.int64) + 1, 0)
    which = np.repeat(np.arange(len(rows)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return which, k, start[which] + k * step[which]


Sample = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _moved(s: Sample, along: np.ndarray | float, right: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Samples' points moved along their tangents and to their right."""
    x, y, tx, ty = s
    return x + tx * along + ty * right, y + ty * along - tx * right


def _branch(s: Sample, degrees: float, length: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """From samples' points, ``length`` in the tangent's direction turned clockwise."""
    (x, y, tx, ty), c, d = s, math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return (x, y), (x + (tx * c + ty * d) * length, y + (ty * c - tx * d) * length)


def _half_disc(s: Sample, radius: np.ndarray, right: np.ndarray | float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Half a disc on one side of lines (right: 1 or -1), nine points and the first again."""
    turns = [(1 - k % (ARC_STEPS + 1) / ARC_STEPS) * math.pi for k in range(ARC_STEPS + 2)]
    return [_moved(s, radius * math.cos(t), radius * math.sin(t) * right) for t in turns]


def generate(rule: Rule, lines: Polylines, rows: np.ndarray, level: np.ndarray, out: Pieces) -> None:
    """All pieces of one rule's symbol on the lines ``rows``, whose map levels are ``level``."""
    mm = dict(zip(SIZES[rule.generator], rule.sizes, strict=True))
    rows, level = rows[lines.some[rows]], level[lines.some[rows]]
    if not len(rows):
        return
    m = {k: v * level / 1000.0 for k, v in mm.items()}
    total, margin, name = lines.total[rows], MARGIN_MM * level / 1000.0, rule.decoration
    every, none = np.arange(len(rows)), np.zeros(len(rows))

    def along(ok: np.ndarray, start: np.ndarray, end: np.ndarray, step: np.ndarray):
        which, k, d = stations(rows[ok], start[ok], end[ok], step[ok])
        which = every[ok][which]
        return which, k, d, lines.sample(rows[which], d)

    if rule.generator == "ticks":
        w, k, _, s = along(total > margin * 2, margin, total - margin, m["interval"])
        # On the right alone, or from the right to the left of the line.
        near, far = (0.0, m["length"][w]) if mm["right"] else (m["length"][w] / 2, -m["length"][w] / 2)
        out.add(rows[w], k, name, "line", _moved(s, 0, near), _moved(s, 0, far))
    elif rule.generator == "ends":
        s = lines.edge[rows]
        first, last = (lines.x0[s], lines.y0[s], lines.tx[s], lines.ty[s]), lines.sample(rows, total)
        for rank, (at, degrees) in enumerate(((first, 135), (first, 225), (last, 45), (last, 315))):
            if mm["both"] or degrees in (135, 45):  # one side, or both
                out.add(rows, np.full(len(rows), rank), name, "line", *_branch(at, degrees, m["length"]))
    elif rule.generator == "triangles":
        base, height = m["base"], math.sqrt(mm["side"] * mm["side"] - mm["base"] * mm["base"] / 4) * level / 1000.0
        w, k, _, s = along(total > margin * 2 + base * 2, margin, total - margin - base * 2, m["interval"])
        b, h = base[w], height[w]
        out.add(rows[w], k, name, "line", _moved(s, 0, 0), _moved(s, b / 2, h), _moved(s, b, 0), _moved(s, b * 1.5, -h), _moved(s, b * 2, 0))
    elif rule.generator == "semicircles":
        r = m["diameter"] / 2
        w, k, _, s = along(total > r * 2, r, total - r, m["interval"])
        out.add(rows[w], k, name, "polygon", *_half_disc(s, r[w], 1.0))
    elif rule.generator == "dash_dots":
        w, k, d = stations(rows, none, total, m["cycle"])
        w, k, d = (v[d < total[w]] for v in (w, k, d))
        out.add_parts(lines, rows[w], k, name, d, np.minimum(d + m["dash"][w], total[w]))
        w, k, _, s = along(total > -1, m["offset"], total, m["cycle"])
        out.add(rows[w], k + (1 << 40), "gap_circle", "point", _moved(s, 0, 0))
    elif rule.generator == "arcs":
        half = m["width"] / 2
        w, k, _, s = along(total > half * 2, half, total - half, m["interval"])
        turns = [j / ARC_STEPS * math.pi for j in range(ARC_STEPS + 1)]
        out.add(rows[w], 2 * k, name, "line", *(_moved(s, half[w] * math.cos(t), m["height"][w] * (1 - math.sin(t))) for t in turns))
        out.add(rows[w], 2 * k + 1, "center_chord", "line", _moved(s, -m["chord"][w] / 2, m["height"][w]), _moved(s, m["chord"][w] / 2, m["height"][w]))
    elif rule.generator == "boundary":
        w, k, d = stations(rows, none, total, m["cycle"])
        w, k, d = (v[d < total[w]] for v in (w, k, d))
        for rank, degrees, at in ((1, 135, d), (2, 225, d), (3, 45, d + m["dash"][w]), (4, 315, d + m["dash"][w])):
            there = at <= total[w]
            out.add(rows[w[there]], 6 * k[there] + rank, "major_dash_end", "line", *_branch(lines.sample(rows[w[there]], at[there]), degrees, m["branch"][w[there]]))
        out.add_parts(lines, rows[w], 6 * k, name, d, np.minimum(d + m["dash"][w], total[w]))
        minor = d + m["dash"][w] + m["gap"][w]
        there = minor < total[w]
        w, k, minor = w[there], k[there], minor[there]
        out.add_parts(lines, rows[w], 6 * k + 5, "minor_dash", minor, np.minimum(minor + m["minor"][w], total[w]))
    elif rule.generator == "pipe":
        _pipe(name, lines, rows, m["diameter"] / 2, m["interval"], out)
    else:
        raise ValueError(f"unknown generator: {rule.generator}")


def _pipe(name: str, lines: Polylines, rows: np.ndarray, radius: np.ndarray, interval: np.ndarray, out: Pieces) -> None:
    """Half discs outside the two longest sides of rings: at their ends and on both sides of their middles."""
    place, found = lines.places(), []
    for row, r, gap in zip(rows.tolist(), radius.tolist(), interval.tolist(), strict=True):
        a, n = lines.first[row], int(lines.sizes[row])
        x, y = lines.x[a : a + n], lines.y[a : a + n]
        if n > 1 and x[0] == x[-1] and y[0] == y[-1]:
            x, y = x[:-1], y[:-1]
        cx, cy = x.mean(), y.mean()
        own = np.arange(lines.edge[row], lines.edge[row + 1])
        for side in own[np.argsort(place[own])][:2].tolist():
            length, tx, ty, x0, y0 = (float(v[side]) for v in (lines.length, lines.tx, lines.ty, lines.x0, lines.y0))
            if length <= r * 2:
                continue
            right = 1.0 if ty * (cx - x0 - tx * length / 2) - tx * (cy - y0 - ty * length / 2) < 0 else -1.0
            last = -math.inf
            for d in sorted(v for v in (r, length / 2 - gap / 2, length / 2 + gap / 2, length - r) if r <= v <= length - r):
                if d - last >= LEAST:
                    found.append((row, len(found), x0 + tx * d, y0 + ty * d, tx, ty, r, right))
                    last = d
    columns = np.array(found, dtype=np.float64).reshape(-1, 8).T
    out.add(columns[0].astype(np.int64), columns[1].astype(np.int64), name, "polygon", *_half_disc(tuple(columns[2:6]), columns[6], columns[7]))


def decorate(features: DataFrame, codes: list[int] | None = None, by_axis: bool = True) -> DataFrame:
    """The symbols of ``features`` (dmcode, kind, zone, map_level, dmfigtype, pts and, if there, gtype, user_id and source_file), one row each with deco_index from 1 per feature. With ``codes``, of those codes alone.

    ``by_axis``: how the shortest steps of dashes are told, see ``Polylines.parts``; by axis is the map style's rule.
    """
    chosen = {r.code: r for r in CATALOGUE if codes is None or r.code in codes}
    wanted = F.lit(False)
    for r in chosen.values():
        own = (F.col("dmcode") == r.code) & (F.col("kind") == r.kind) & F.col("map_level").cast("int").isin(*r.levels)
        wanted = wanted | (own if r.figtype is None else own & (F.col("dmfigtype") == r.figtype))
    wanted = wanted & ~F.col("dmfigtype").eqNullSafe(F.lit(SUPPRESSED))
    if "gtype" in features.columns:  # circles and arcs have no symbols
        wanted = wanted & F.col("gtype").isin("line", "polygon")
    kept = [c for c in features.columns if c != "pts"]
    point = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    schema = T.StructType([*features.select(*kept).schema.fields, T.StructField("decoration", T.StringType()), T.StructField("deco_index", T.LongType()), T.StructField("deco_kind", T.StringType()), T.StructField("pts", T.ArrayType(point))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lines, out = Polylines(batch.column("pts")), Pieces(by_axis)
            code, level = (np.asarray(batch.column(c), dtype=np.int64) for c in ("dmcode", "map_level"))
            for c in np.unique(code).tolist():
                rows = np.flatnonzero(code == c)
                generate(chosen[c], lines, rows, level[rows].astype(np.float64), out)
            row, index, label, points, sizes = out.in_order()
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            labels = [pa.array([x[k] for x in out.labels], pa.string()) for k in (0, 1)]
            # A long line may have very many symbols; they leave in slices.
            for a in range(0, len(row), 20_000):
                b = min(a + 20_000, len(row))
                xy = points[offsets[a] : offsets[b]]
                pts = pa.ListArray.from_arrays(pa.array((offsets[a : b + 1] - offsets[a]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"]))
                take, mark = pa.array(row[a:b]), pa.array(label[a:b])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in kept), labels[0].take(mark), pa.array(index[a:b]), labels[1].take(mark), pts], [*kept, "decoration", "deco_index", "deco_kind", "pts"])

    return features.where(wanted).select(*kept, "pts").mapInArrow(run, schema)


def with_source(decorated: DataFrame) -> DataFrame:
    """The lineage columns of a decoration table: its layer and its source's layer, id, file and code."""
    key = [F.col(c) for c in ("dmcode", "kind", "zone", "map_level")]
    return decorated.withColumns({"layer": names.layer_name(*key, F.col("deco_kind")), "src_layer": names.layer_name(*key), "src_user_id": F.col("user_id"), "src_dmfile": F.col("source_file"), "src_dmcode": F.col("dmcode")})


def orphans(decorated: DataFrame, features: DataFrame) -> DataFrame:
    """Decorations (with their source's columns) whose source is not among ``features`` (the columns of a layer's key and user_id)."""
    layer = names.layer_name(*(F.col(c) for c in ("dmcode", "kind", "zone", "map_level")))
    return decorated.join(features.select(layer.alias("src_layer"), F.col("user_id").alias("src_user_id")), ["src_layer", "src_user_id"], "left_anti")
