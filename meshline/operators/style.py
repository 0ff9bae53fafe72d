"""Style documents as rows: expansion of default layers, visibility, colours, labels."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshline.functions import names

ROWS = "ord long, id string, type string, source string, source_layer string, filter string, layout string, paint string"
#: Which layers and features the map leaves out. Fixed values of the map style.
SKIP_FILTER = ["!=", ["coalesce", ["get", "DMSKIP"], 0], 1]
FIGTYPE_FILTER = ["!=", ["get", "DMFIGTYPE"], 12]
FIGTYPE_LAYER = "dm_6101_line"
DEFAULT = r"^dm_default_(polygon|line|point|text)"


def canonical(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def rows(spark: SparkSession, document: dict) -> DataFrame:
    """The layers of a style document in order."""
    if document.get("version") != 8 or not isinstance(document.get("layers"), list):
        raise ValueError("not a style document of version 8")
    found = [(k, x["id"], x["type"], x.get("source"), x.get("source-layer"), canonical(x["filter"]) if "filter" in x else None, canonical(x.get("layout", {})), canonical(x.get("paint", {}))) for k, x in enumerate(document["layers"])]
    return spark.createDataFrame(found, ROWS)


def document(layers: DataFrame, base: dict) -> dict:
    """``base`` with the layers of a frame in order. A style is small: it is one file."""
    out = []
    for r in layers.orderBy("ord", "id").collect():
        x = {"id": r["id"], "type": r["type"]} | {k: v for k, v in (("source", r["source"]), ("source-layer", r["source_layer"])) if v}
        x |= {"filter": json.loads(r["filter"])} if r["filter"] else {}
        out.append(x | {"layout": json.loads(r["layout"]), "paint": json.loads(r["paint"])})
    return base | {"layers": out}


def literal_codes(filters: Column) -> Column:
    """The first literal list of whole numbers inside a filter."""
    return F.from_json(F.nullif(F.regexp_extract(filters, r'\["literal",(\[[0-9, ]*\])\]', 1), F.lit("")), "array<int>")


def expand_defaults(layers: DataFrame, source_layers: DataFrame) -> DataFrame:
    """A default layer becomes one layer for each source layer (name) of its kind but those whose codes its filter excludes; others stay. Order is kept."""
    found = source_layers.select(F.col("name").alias("_name"), names.source_layer_kind(F.col("name")).alias("_kind"), names.source_layer_code(F.col("name")).alias("_code")).distinct()
    marked = layers.withColumn("_default", F.nullif(F.regexp_extract(F.coalesce("source_layer", F.lit("")), DEFAULT, 1), F.lit("")))
    joined = marked.join(found, (F.col("_default") == F.col("_kind")), "left").where("_default is null or _name is not null")
    excluded = F.coalesce(F.array_contains(literal_codes(F.col("filter")), F.col("_code")), F.lit(False))
    kept = joined.where(F.col("_default").isNull() | ~excluded)
    return kept.withColumns({"id": F.when(F.col("_default").isNull(), F.col("id")).otherwise(F.concat_ws("-", "id", "_name")), "source_layer": F.coalesce(F.when(F.col("_default").isNotNull(), F.col("_name")), F.col("source_layer"))}).drop("_default", "_name", "_kind", "_code")


def _also(filters: Column, extra: list, wanted: Column) -> Column:
    """A filter and one more condition, unless it is in it already."""
    text = canonical(extra)
    inner = F.when(filters.startswith('["all",'), F.concat(F.substring(filters, 1, 10_000_000).substr(F.lit(1), F.length(filters) - 1), F.lit(f",{text}]"))).otherwise(F.concat(F.lit('["all",'), filters, F.lit(f",{text}]")))
    return F.when(~wanted | F.coalesce(filters.contains(text), F.lit(False)), filters).when(filters.isNull(), F.lit(text)).otherwise(inner)


def visible(layers: DataFrame) -> DataFrame:
    """Adds the conditions under which features of our source layers show; a second time changes nothing."""
    ours = F.coalesce(F.col("source_layer").startswith("dm_"), F.lit(False))
    once = layers.withColumn("filter", _also(F.col("filter"), SKIP_FILTER, ours))
    return once.withColumn("filter", _also(F.col("filter"), FIGTYPE_FILTER, F.coalesce(F.col("source_layer") == FIGTYPE_LAYER, F.lit(False))))


def shows(skip: Column, source_layer: Column, figtype: Column) -> Column:
    """The same conditions on features."""
    return (F.coalesce(skip, F.lit(0)) != 1) & ~((source_layer == FIGTYPE_LAYER) & figtype.eqNullSafe(F.lit(12)))


def color_property(kind: Column) -> Column:
    return F.when(kind == "fill", "fill-color").when(kind == "line", "line-color").when(kind == "circle", "circle-color").when(kind == "symbol", "text-color")


def editable(layers: DataFrame) -> DataFrame:
    """Distinct editable kinds with the place of their first layer."""
    return layers.withColumn("property", color_property(F.col("type"))).where("property is not null").groupBy("type", "property").agg(F.min("ord").alias("ord"))


def set_color(layers: DataFrame, color: str, kind: str | None = None, layer: str | None = None) -> DataFrame:
    """The colour of one layer, or of all of a kind."""
    hit = (F.col("id") == layer) if layer is not None else (F.col("type") == kind)
    paint = F.to_json(F.map_concat(F.map_filter(F.from_json("paint", "map<string,string>"), lambda k, v: k != color_property(F.col("type"))), F.create_map(color_property(F.col("type")), F.lit(color))))
    return layers.withColumn("paint", F.when(hit & color_property(F.col("type")).isNotNull(), paint).otherwise(F.col("paint")))


def set_visibility(layers: DataFrame, layer: str, shown: bool) -> DataFrame:
    layout = F.to_json(F.map_concat(F.map_filter(F.from_json("layout", "map<string,string>"), lambda k, v: k != "visibility"), F.create_map(F.lit("visibility"), F.lit("visible" if shown else "none"))))
    return layers.withColumn("layout", F.when(F.col("id") == layer, layout).otherwise(F.col("layout")))


def vertical_labels(layers: DataFrame, vertical: Column) -> DataFrame:
    """Text layers that show upright forms where ``vertical`` holds."""
    field = F.when(vertical, F.replace("layout", F.lit('["get","TEXT"]'), F.lit('["coalesce",["get","TEXT_VERTICAL"],["get","TEXT"]]'))).otherwise(F.replace("layout", F.lit('["coalesce",["get","TEXT_VERTICAL"],["get","TEXT"]]'), F.lit('["get","TEXT"]')))
    return layers.withColumn("layout", F.when(F.col("type") == "symbol", field).otherwise(F.col("layout")))


def runtime_layers(base: DataFrame, running: DataFrame) -> DataFrame:
    """Pairs (base id, running id) of layers with the same id or one that begins with it and a dash."""
    a, b = base.select(F.col("id").alias("base_id")), running.select(F.col("id").alias("running_id"))
    # Every prefix of a running id that ends before a dash is a possible base: an equi-join, not all pairs.
    parts = F.split("running_id", "-")
    possible = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))
    return b.withColumn("base_id", F.explode(possible)).join(a, "base_id").select("base_id", "running_id")


def natural_order(layers: DataFrame) -> DataFrame:
    """Distinct source layers with numbers in their names sorted as numbers."""
    return layers.where("source_layer is not null").select("source_layer").distinct().withColumn("key", names.natural_key(F.col("source_layer"))).orderBy("key")


def runtime_document(doc: dict, archive: str, sprite: str, glyphs: str, basemap: dict | None = None, hidden: list[str] = ()) -> dict:
    """A document for a running map: archive URL, sprite and glyphs, a raster basemap below all layers, hidden layers."""
    out = json.loads(json.dumps(doc))
    for source in out.get("sources", {}).values():
        if source.get("type") == "vector":
            source["url"] = archive if archive.startswith("pmtiles://") else f"pmtiles://{archive}"
    out |= {"sprite": sprite, "glyphs": glyphs}
    if basemap:
        out.setdefault("sources", {})["basemap"] = basemap
        out["layers"] = [{"id": "basemap", "type": "raster", "source": "basemap"}, *out["layers"]]
    for layer in out["layers"]:
        if layer["id"] in hidden:
            layer.setdefault("layout", {})["visibility"] = "none"
    return out


def bundled_document(doc: dict, layer_name: str, level: int, bounds: list[float]) -> dict:
    """A document for a folder that is served as it is: relative paths, and what the manifest says in its metadata."""
    out = runtime_document(doc, f"pmtiles://{layer_name}.pmtiles", "sprite", "glyphs/{fontstack}/{range}.pbf")
    return out | {"metadata": out.get("metadata", {}) | {"dm:layer": layer_name, "dm:level": level, "bounds": bounds}}
