"""Paged queries over features, their labels, details and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshline.functions import geometry as G
from meshline.functions import names
from meshline.functions.values import last_page

PAGE_SIZE, MOST_PAGE_SIZE = 50, 100
CLICK_PIXELS = 6


def query_problems(layer: Column, page: Column, size: Column) -> Column:
    """What is wrong with a feature query's parameters (texts; no size means the default); empty if nothing."""
    n, m = page.try_cast("long"), F.coalesce(size, F.lit(str(PAGE_SIZE))).try_cast("long")
    whole = lambda t: t.rlike(r"^\d+$")
    checks = [(~F.coalesce(layer.rlike(r"^dm_\d+_(polygon|line|point|text)(_deco_(polygon|line|point))?$"), F.lit(False)), "layer"), (~F.coalesce(whole(page) & (n >= 1), F.lit(False)), "page"), (~F.coalesce(whole(F.coalesce(size, F.lit(str(PAGE_SIZE)))) & m.between(1, MOST_PAGE_SIZE), F.lit(False)), "pageSize")]
    return F.filter(F.array(*(F.when(bad, F.lit(name)) for bad, name in checks)), lambda v: v.isNotNull())


def counts(rows: DataFrame) -> DataFrame:
    """(source_layer, total)."""
    return rows.groupBy("source_layer").agg(F.count("*").alias("total"))


def page(rows: DataFrame, layer: str, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page of a source layer's features in (table_name, fid) order. Sorts only as many rows as the page's end needs."""
    if number < 1 or not 1 <= size <= MOST_PAGE_SIZE:
        raise ValueError("page or pageSize out of range")
    return rows.where(F.col("source_layer") == layer).orderBy("table_name", "fid").limit(number * size).orderBy("table_name", "fid").offset((number - 1) * size)


def pages(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with the page each is on in its source layer: offsets of whole tables are summed first, so no layer is one window."""
    tables = rows.groupBy("source_layer", "table_name").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("source_layer").orderBy("table_name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("source_layer", "table_name").orderBy("fid"))
    joined = rows.withColumn("_i", inside).join(tables.withColumn("_before", before).drop("_n"), ["source_layer", "table_name"])
    return joined.withColumn("page", (F.floor((F.col("_before") + F.col("_i") - 1) / size) + 1).cast("long")).drop("_i", "_before")


def page_status(total: Column, number: Column, size: Column) -> Column:
    last = last_page(total, size)
    return F.struct(last.alias("last_page"), (number <= 1).alias("first"), (number >= last).alias("last"))


def responses(rows: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """(source_layer, body): the JSON answer for one page of every source layer: total, page, pageSize and the page's features by table and fid."""
    items = pages(rows, size).where(F.col("page") == number).groupBy("source_layer").agg(F.array_sort(F.collect_list(F.struct("table_name", "fid"))).alias("features"))
    whole = counts(rows).join(items, "source_layer", "left")
    none = F.array().cast("array<struct<table_name:string,fid:bigint>>")
    return whole.select("source_layer", F.to_json(F.struct("total", F.lit(number).alias("page"), F.lit(size).alias("pageSize"), F.coalesce("features", none).alias("features"))).alias("body"))


def as_feature(rows: DataFrame, properties: list[str]) -> DataFrame:
    """id, bbox, center and properties of features with ``pts``."""
    box = G.envelope(F.col("pts"))
    center = G.let(box, lambda b: G.point((b["min_x"] + b["max_x"]) / 2, (b["min_y"] + b["max_y"]) / 2))
    return rows.select(F.concat_ws(":", "table_name", F.col("fid").cast("string")).alias("id"), box.alias("bbox"), center.alias("center"), F.create_map(*(x for c in properties for x in (F.lit(c), F.col(c).cast("string")))).alias("properties"))


def bbox_of(coordinates: Column, depth: int = 0) -> Column:
    """Envelope of coordinates nested ``depth`` lists deep around a list of points."""
    for _ in range(depth):
        coordinates = F.flatten(coordinates)
    return G.envelope(coordinates)


def rotation_of_highlight(rotation: Column, angle: Column) -> Column:
    """ROTATION, or ANGLE where there is none; an angle of 0 counts as none."""
    return F.coalesce(rotation, F.when(angle != 0, angle))


def title(user_id: Column, feature_id: Column, fid: Column, text: Column) -> Column:
    """USER_ID and the first id there is, and the text."""
    return F.concat(F.lit("USER_ID "), F.coalesce(user_id.cast("string"), feature_id.cast("string"), fid.cast("string"), F.lit("")), F.coalesce(F.concat(F.lit(" "), F.nullif(text, F.lit(""))), F.lit("")))


def meta(*parts: Column) -> Column:
    return F.concat_ws(" / ", *(F.nullif(p, F.lit("")) for p in parts))


def details(rows: DataFrame, properties: Column) -> DataFrame:
    """(id, name, value): the properties unpivoted; null is the word null."""
    return rows.select("id", F.explode(properties).alias("name", "value")).withColumn("value", F.coalesce("value", F.lit("null")))


def layer_names(codes: DataFrame, table: DataFrame, texts: DataFrame) -> DataFrame:
    """``codes`` (code, kind) with the name of each: of text layers from ``texts`` first, then from ``table`` (both code, name), else empty."""
    key = names.padded_code(F.col("code").cast("string"))
    a = table.select(F.col("code").alias("_a"), F.col("name").alias("_name"))
    b = texts.select(F.col("code").alias("_b"), F.col("name").alias("_text"))
    joined = codes.withColumn("_key", key).join(a, F.col("_key") == F.col("_a"), "left").join(b, (F.col("_key") == F.col("_b")) & (F.col("kind") == "text"), "left")
    return joined.withColumn("layer_name", F.coalesce("_text", "_name", F.lit(""))).drop("_key", "_a", "_name", "_b", "_text")


def filter_layers(layers: DataFrame, kind: str, query: str) -> DataFrame:
    """Layers (name, kind) of a kind, if one is given, whose names hold the query, without regard to case."""
    return layers.where((F.lit(kind) == "") | (F.col("kind") == kind)).where(F.lower("name").contains(query.strip().lower()))


def navigation(bbox: Column, zoom: Column) -> Column:
    """Where to go for a feature: its box, or, where that is a point, the centre at zoom 18 at least."""
    flat = (bbox["min_x"] == bbox["max_x"]) & (bbox["min_y"] == bbox["max_y"])
    return F.struct(F.when(~flat, bbox).alias("bounds"), ((bbox["min_x"] + bbox["max_x"]) / 2).alias("x"), ((bbox["min_y"] + bbox["max_y"]) / 2).alias("y"), F.when(flat, F.greatest(zoom, F.lit(18.0))).alias("zoom"))


def clicked(rows: DataFrame, x: float, y: float) -> DataFrame:
    """Visible features (kind, visible, screen envelope) at a point; lines within six pixels. In order of kind, then as they came."""
    buffer = F.when(F.col("kind") == "line", float(CLICK_PIXELS)).otherwise(0.0)
    hit = (F.col("min_x") - buffer <= x) & (F.col("max_x") + buffer >= x) & (F.col("min_y") - buffer <= y) & (F.col("max_y") + buffer >= y)
    return rows.where("visible").where(hit).orderBy(names.kind_priority(F.col("kind")), "ord")
