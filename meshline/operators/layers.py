"""Layers: keys, names, surrogate ids, counts and envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshline.functions import geometry as G
from meshline.functions import names, projection

KEY = ["dmcode", "kind", "zone", "map_level"]


def key_order() -> list[Column]:
    return [F.col("dmcode"), names.kind_order(F.col("kind")), F.col("zone").asc_nulls_first(), F.col("map_level").asc_nulls_first()]


def keys(features: DataFrame) -> DataFrame:
    """The distinct layer keys with their names and reference systems."""
    return features.select(*KEY).distinct().withColumns({"layer": names.layer_name(*map(F.col, KEY)), "srs_id": projection.zone_to_epsg(F.col("zone"))}).withColumn("srs_id", F.coalesce("srs_id", F.lit(-1)))


def with_user_ids(features: DataFrame) -> DataFrame:
    """``features`` with user_id, counted from 1 in each layer by file and line.

    A layer may hold a third of all features, so it is not one window: each
    layer is cut into file-ordered slices whose counts are summed first, and
    numbers inside a slice are a window over that slice alone.
    """
    slices = [*KEY, "path"]
    counts = features.groupBy(*slices).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*KEY).orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*(F.col(c).alias(f"_{c}") for c in slices), F.coalesce(before, F.lit(0)).alias("_before"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in slices]
    inside = F.row_number().over(Window.partitionBy(*slices).orderBy("source_line"))
    return features.withColumn("_inside", inside).join(offsets, same).withColumn("user_id", F.col("_before") + F.col("_inside")).drop("_inside", "_before", *(f"_{c}" for c in slices))


def summary(features: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per layer: number of features, envelope and total length of their points. Folded per task before the shuffle."""
    e = G.envelope(F.col("pts"))
    rows = features.select(*(by or KEY), e["min_x"].alias("x0"), e["max_x"].alias("x1"), e["min_y"].alias("y0"), e["max_y"].alias("y1"), G.line_length(F.col("pts")).alias("len"))
    return rows.groupBy(*(by or KEY)).agg(F.count("*").alias("features"), F.min("x0").alias("min_x"), F.max("x1").alias("max_x"), F.min("y0").alias("min_y"), F.max("y1").alias("max_y"), F.sum("len").alias("total_length"))


def checked_against(features: DataFrame, defined: DataFrame) -> DataFrame:
    """Features whose layer is not defined: their input has changed since the layers were found. Empty if all is well."""
    return features.join(defined.select(*KEY), [features[c].eqNullSafe(defined[c]) for c in KEY], "left_anti")

