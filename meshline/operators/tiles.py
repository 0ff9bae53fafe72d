"""The tile grid: projection, candidate tiles, distribution of features, weights.

A feature meets tiles by range expansion (zoom, then columns, then rows of its
buffered envelope), never by comparing features with tiles; candidates are a
left-semi join on the tile key. Only keys and projected points are expanded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshline.functions import geometry as G
from meshline.functions import names, projection
from meshline.functions.values import round_away

#: Zooms of the archive, tile units per tile, buffer and line tolerance in tile units. Fixed values.
ZOOMS, EXTENT, BUFFER, TOLERANCE = (14, 18), 4096, 64, 4.0
HALF = projection.HALF_WORLD


def project(features: DataFrame) -> DataFrame:
    """``features`` with ``pts`` in Web Mercator metres; those without a zone do not project and are an error in ``checked_zones``."""
    return features.withColumn("pts", F.transform("pts", lambda p: projection.to_mercator(F.col("zone"), p["x"], p["y"])))


def checked_zones(features: DataFrame) -> DataFrame:
    """Ends the query at a feature outside the zones."""
    bad = F.col("zone").isNull() | ~F.col("zone").between(1, 19)
    return features.withColumn("zone", F.when(bad, F.raise_error(F.lit("feature outside the plane-rectangular zones"))).otherwise(F.col("zone")))


def column_of(x: Column, zoom: Column) -> Column:
    n = F.pow(F.lit(2.0), zoom)
    return F.least(F.greatest(F.floor((x + HALF) / (2 * HALF) * n), F.lit(0)), n.cast("long") - 1).cast("int")


def row_of(y: Column, zoom: Column) -> Column:
    n = F.pow(F.lit(2.0), zoom)
    return F.least(F.greatest(F.floor((F.lit(HALF) - y) / (2 * HALF) * n), F.lit(0)), n.cast("long") - 1).cast("int")


def _expand(rows: DataFrame, box: Column, buffer: float, zooms: tuple[int, int]) -> DataFrame:
    """``rows`` for every tile that the box (min_x, max_x, min_y, max_y in metres) with a buffer of tile units touches."""
    z = F.col("z")
    margin = F.lit(2 * HALF) / F.pow(F.lit(2.0), z) * (buffer / EXTENT)
    out = rows.withColumn("_box", box).withColumn("z", F.explode(F.sequence(F.lit(zooms[0]), F.lit(zooms[1]))))
    # Rows without a box go here; a filter before would be moved below the projection of points, and project them twice.
    out = out.withColumn("x", F.explode(F.when(F.col("_box").isNotNull(), F.sequence(column_of(F.col("_box.min_x") - margin, z), column_of(F.col("_box.max_x") + margin, z)))))
    return out.withColumn("y", F.explode(F.sequence(row_of(F.col("_box.max_y") + margin, z), row_of(F.col("_box.min_y") - margin, z)))).drop("_box")


def feature_tiles(projected: DataFrame, zooms: tuple[int, int] = ZOOMS) -> DataFrame:
    """``projected`` once per tile it may show in."""
    return _expand(projected, G.envelope(F.col("pts")), BUFFER, zooms)


def candidates(layers: DataFrame, zooms: tuple[int, int] = ZOOMS) -> DataFrame:
    """The distinct tiles (z, x, y) of all layers' envelopes (zone, min_x, ...); layers without an envelope have none."""
    corner = lambda x, y: projection.to_mercator(F.col("zone"), F.col(x), F.col(y))
    corners = F.array(corner("min_x", "min_y"), corner("min_x", "max_y"), corner("max_x", "min_y"), corner("max_x", "max_y"))
    return _expand(layers.where("min_x is not null").select(corners.alias("c")), G.envelope(F.col("c")), 0.0, zooms).select("z", "x", "y").distinct()


def in_candidates(tiled: DataFrame, found: DataFrame) -> DataFrame:
    return tiled.join(found, ["z", "x", "y"], "left_semi")


def weights(found: DataFrame, tiled: DataFrame) -> DataFrame:
    """(z, x, y, weight) of every candidate: one and one more per feature."""
    counts = tiled.groupBy("z", "x", "y").count()
    return found.join(counts, ["z", "x", "y"], "left").select("z", "x", "y", (F.coalesce("count", F.lit(0)) + 1.0).alias("weight"))


def local(pts: Column, z: Column, x: Column, y: Column) -> Column:
    """Points in whole tile units of a tile."""
    n = F.pow(F.lit(2.0), z)
    return F.transform(pts, lambda p: F.struct(round_away(((p["x"] + HALF) / (2 * HALF) * n - x) * EXTENT).alias("x"), round_away(((F.lit(HALF) - p["y"]) / (2 * HALF) * n - y) * EXTENT).alias("y")))


def inside(p: Column) -> Column:
    return p["x"].between(-BUFFER, EXTENT + BUFFER) & p["y"].between(-BUFFER, EXTENT + BUFFER)


def dataset_summary(layers: DataFrame) -> DataFrame:
    """One row: number of features, levels, source layers and bounds in degrees, from layers (layer, zone, map_level, features, envelope)."""
    corner = lambda x, y: projection.to_degrees(F.col("zone"), F.col(x), F.col(y))
    c = F.array(corner("min_x", "min_y"), corner("min_x", "max_y"), corner("max_x", "min_y"), corner("max_x", "max_y"))
    low = lambda k: F.array_min(F.transform("c", lambda p: p[k]))
    high = lambda k: F.array_max(F.transform("c", lambda p: p[k]))
    rows = layers.withColumn("c", c)
    return rows.agg(
        F.sum("features").alias("features"), F.array_sort(F.collect_set("map_level")).alias("levels"), F.array_sort(F.collect_set(names.source_layer(F.col("layer")))).alias("source_layers"),
        F.min(low("lon")).alias("west"), F.min(low("lat")).alias("south"), F.max(high("lon")).alias("east"), F.max(high("lat")).alias("north"),
    )
