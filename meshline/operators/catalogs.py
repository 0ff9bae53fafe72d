"""Layer lists and sprite icons as joins, and progress of a weighted run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshline.functions import names
from meshline.functions.values import eta
from meshline.operators.featurequery import filter_layers

ICON_SIZE = 32


def by_kind(source_layers: DataFrame) -> DataFrame:
    """(kind, names): source layers (name) grouped by kind, in natural order. A kind has as many as the map style has codes."""
    keyed = source_layers.select("name", names.source_layer_kind(F.col("name")).alias("kind"), names.natural_key(F.col("name")).alias("key")).distinct()
    return keyed.groupBy("kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "name"))), lambda x: x["name"]).alias("names"))


def layer_options(layers: DataFrame, kind: str, query: str, selected: str) -> DataFrame:
    """(name, selected): the choice of layers (name, kind), an empty one first; what was selected stays so if it is still there."""
    found = filter_layers(layers, kind, query).select("name").distinct()
    none = layers.sparkSession.createDataFrame([("",)], "name string")
    return none.unionByName(found).withColumn("selected", F.col("name") == selected).orderBy(F.col("name") != "", names.natural_key(F.col("name")))


def geometry_group(gtype: Column) -> Column:
    """Which highlight style shows a geometry type, single or multiple."""
    return F.when(gtype.rlike("Polygon$"), "polygon").when(gtype.rlike("LineString$"), "line").when(gtype.rlike("Point$"), "point")


def icons(sprites: DataFrame, sources: DataFrame, sizes: DataFrame) -> DataFrame:
    """Sprites (id) with their files (id, file) and sizes (id, width, height; 32 x 32 where none is given); a sprite without a file ends the query."""
    joined = sprites.join(sources, "id", "left").join(sizes, "id", "left")
    file = F.when(F.col("file").isNull(), F.raise_error(F.concat(F.lit("no icon for "), F.col("id")))).otherwise(F.col("file"))
    return joined.select("id", file.alias("file"), F.coalesce("width", F.lit(ICON_SIZE)).alias("width"), F.coalesce("height", F.lit(ICON_SIZE)).alias("height"))


def icon_order(icons: DataFrame, first: tuple[str, ...]) -> DataFrame:
    """Icons in the order of the atlas: some by name first, then all others by name."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, first)), F.col("id")), F.lit(0)), F.lit(len(first) + 1))
    return icons.orderBy(place, "id")


def progress(steps: DataFrame, run: str = "run") -> DataFrame:
    """Steps (run, n, weight, elapsed) with the weight done so far and the seconds left. A run's steps are as many as it prints."""
    so_far = Window.partitionBy(run).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    done, whole = F.sum("weight").over(so_far), F.sum("weight").over(Window.partitionBy(run))
    return steps.withColumns({"done": done, "total": whole}).withColumn("left_s", eta(F.col("elapsed"), F.col("done"), F.col("total")))
