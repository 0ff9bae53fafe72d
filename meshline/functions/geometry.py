"""Plane geometry as Columns over ``array<struct<x:double,y:double>>``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = 3.141592653589793
EPSILON = 2.220446049250313e-16
POINT = "struct<x:double,y:double>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def points(*xy: tuple[float, float]) -> Column:
    return F.array(*(point(F.lit(float(x)), F.lit(float(y))) for x, y in xy))


def hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Names a value inside an expression, so that it is written (and computed) once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def pairs(pts: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of every two consecutive points."""
    n = F.greatest(F.size(pts) - 1, F.lit(0))
    return F.zip_with(F.slice(pts, F.lit(1), n), F.slice(pts, F.lit(2), n), body)


def line_length(pts: Column) -> Column:
    return total(pairs(pts, lambda a, b: hypot(b["x"] - a["x"], b["y"] - a["y"])))


def close_ring(pts: Column) -> Column:
    first, last = F.element_at(pts, 1), F.element_at(pts, -1)
    return F.when(F.size(pts) == 0, pts).when((first["x"] == last["x"]) & (first["y"] == last["y"]), pts).otherwise(F.concat(pts, F.array(first)))


def open_ring(pts: Column) -> Column:
    """The ring without its closing point."""
    first, last = F.element_at(pts, 1), F.element_at(pts, -1)
    return F.when((F.size(pts) > 1) & (first["x"] == last["x"]) & (first["y"] == last["y"]), F.slice(pts, F.lit(1), F.size(pts) - 1)).otherwise(pts)


def centroid(pts: Column) -> Column:
    """The mean of a ring's vertices."""
    return let(open_ring(pts), lambda r: F.when(F.size(r) == 0, point(F.lit(0.0), F.lit(0.0))).otherwise(point(total(F.transform(r, lambda p: p["x"])) / F.size(r), total(F.transform(r, lambda p: p["y"])) / F.size(r))))


def signed_area(pts: Column) -> Column:
    """Half the sum of cross products, the last point followed by the first."""
    turned = F.concat(F.slice(pts, F.lit(2), F.greatest(F.size(pts) - 1, F.lit(0))), F.slice(pts, F.lit(1), F.least(F.size(pts), F.lit(1))))
    return total(F.zip_with(pts, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])) / 2


def oriented(pts: Column) -> Column:
    """The ring with an area that is not negative."""
    return F.when(signed_area(pts) < 0, F.reverse(pts)).otherwise(pts)


def envelope(pts: Column) -> Column:
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return F.when(F.size(pts) > 0, F.struct(F.array_min(xs).alias("min_x"), F.array_max(xs).alias("max_x"), F.array_min(ys).alias("min_y"), F.array_max(ys).alias("max_y")))


def circumcircle(a: Column, b: Column, c: Column) -> Column:
    """cx, cy, radius of the circle through three points; null where they are collinear."""
    d = (a["x"] * (b["y"] - c["y"]) + b["x"] * (c["y"] - a["y"]) + c["x"] * (a["y"] - b["y"])) * 2.0
    sq = lambda p: p["x"] * p["x"] + p["y"] * p["y"]
    cx = (sq(a) * (b["y"] - c["y"]) + sq(b) * (c["y"] - a["y"]) + sq(c) * (a["y"] - b["y"])) / F.nullif(d, F.lit(0.0))
    cy = (sq(a) * (c["x"] - b["x"]) + sq(b) * (a["x"] - c["x"]) + sq(c) * (b["x"] - a["x"])) / F.nullif(d, F.lit(0.0))
    return F.when(F.abs(d) >= EPSILON, F.struct(cx.alias("cx"), cy.alias("cy"), hypot(cx - a["x"], cy - a["y"]).alias("radius")))


def direction(a: Column, b: Column) -> Column:
    """Degrees of the way from a to b."""
    return F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))


def turn(degrees: Column) -> Column:
    """Degrees in [0, 360)."""
    return F.pmod(degrees, F.lit(360.0))


def clockwise(start: Column, middle: Column, end: Column) -> Column:
    """Whether an arc through three directions runs clockwise."""
    return turn(end - start) <= turn(middle - start)


def arc_sweep(start: Column, end: Column, is_clockwise: Column) -> Column:
    """Degrees from start to end, negative clockwise; a full turn where they meet is none."""
    ccw = turn(end - start)
    return F.when(is_clockwise, -turn(start - end)).otherwise(ccw)


def circle_points(cx: Column, cy: Column, radius: Column) -> Column:
    """73 points at steps of five degrees; the last is the first."""
    at = lambda i: let(F.radians(i * 5.0), lambda t: point(cx + radius * F.cos(t), cy + radius * F.sin(t)))
    ring = F.transform(F.sequence(F.lit(0), F.lit(71)), at)
    return F.concat(ring, F.slice(ring, 1, 1))


def arc_points(cx: Column, cy: Column, radius: Column, start: Column, sweep: Column) -> Column:
    """Points of an arc at steps of five degrees at most."""
    n = F.greatest(F.ceil(F.abs(sweep) / 5.0).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n), lambda i: let(F.radians(start + sweep * (i / n)), lambda t: point(cx + radius * F.cos(t), cy + radius * F.sin(t))))


def distinct_neighbours(values: Column) -> Column:
    """Without values equal to the one before; the last and the first are not compared."""
    return F.filter(values, lambda v, i: (i == 0) | ~v.eqNullSafe(F.get(values, i - 1)))
