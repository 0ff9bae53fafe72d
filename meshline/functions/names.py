"""Names of layers, tables, sprites and style layers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("polygon", "line", "point", "text")
TABLE_PATTERN = r"^dm_(\d+)_(polygon|line|point|text)_(\d{2})_(\d+)(?:_deco_(polygon|line|point))?$"


def kind_order(kind: Column) -> Column:
    """Sort order of layer keys: polygon, line, point, text."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KINDS)), kind), F.lit(0)), F.lit(9)).cast("int")


def kind_priority(kind: Column) -> Column:
    """Sort order of clicked features: point, line, polygon, text, others."""
    return F.when(kind == "point", 0).when(kind == "line", 1).when(kind == "polygon", 2).when(kind == "text", 3).otherwise(4)


def geometry_type(kind: Column) -> Column:
    return F.when(kind == "polygon", "POLYGON").when(kind == "line", "LINESTRING").otherwise("POINT")


def wkb_type(kind: Column) -> Column:
    return F.when(kind == "polygon", 3).when(kind == "line", 2).otherwise(1)


def layer_name(code: Column, kind: Column, zone: Column, level: Column, deco_kind: Column | None = None) -> Column:
    """dm_{code}_{kind}_{zone}_{level}, with what is missing as unknown, and _deco_{kind} for decorations."""
    base = F.concat_ws("_", F.lit("dm"), code.cast("string"), kind, F.coalesce(F.lpad(zone.cast("string"), 2, "0"), F.lit("unknown")), F.coalesce(level.cast("string"), F.lit("unknown")))
    return base if deco_kind is None else F.concat(base, F.lit("_deco_"), deco_kind)


def parse_table(name: Column) -> Column:
    """The parts of a table name; null where it is not one."""
    part = lambda k: F.nullif(F.regexp_extract(name, TABLE_PATTERN, k), F.lit(""))
    return F.when(
        name.rlike(TABLE_PATTERN),
        F.struct(part(1).cast("long").alias("dmcode"), part(2).alias("kind"), part(3).cast("int").alias("zone"), part(4).cast("long").alias("level"), part(5).alias("deco_kind"), source_layer(name).alias("source_layer")),
    )


def source_layer(table: Column) -> Column:
    """The layer of the tiles that a table's features are in: zone and level left out."""
    parts = F.split(table, "_")
    deco = F.when(F.get(parts, F.lit(5)) == "deco", F.concat(F.lit("_deco_"), F.get(parts, F.lit(6)))).otherwise("")
    return F.concat(F.lit("dm_"), F.get(parts, F.lit(1)), F.lit("_"), F.get(parts, F.lit(2)), deco)


def source_layer_code(name: Column) -> Column:
    return F.regexp_extract(name, r"^dm_(\d+)_", 1).try_cast("int")


def source_layer_kind(name: Column) -> Column:
    deco = F.regexp_extract(name, r"_deco_(polygon|line|point)$", 1)
    return F.when(deco != "", deco).otherwise(F.regexp_extract(name, r"^dm_\d+_(polygon|line|point|text)", 1))


def natural_key(name: Column) -> Column:
    """Sorts runs of digits by their numbers: each is padded to twenty places."""
    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit(r"([0-9]+|[^0-9]+)"), 1), lambda x: F.when(x.rlike("^[0-9]+$"), F.lpad(x, 20, "0")).otherwise(x)), "")


def quote_identifier(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def quote_literal(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def padded_code(code: Column) -> Column:
    """One to four digits as four; anything else is empty."""
    text = F.trim(code)
    return F.when(text.rlike(r"^\d{1,4}$"), F.lpad(text, 4, "0")).otherwise("")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def zone_of_file(path: Column) -> Column:
    """The zone in the first two characters of a file's stem, null outside 1 to 19."""
    zone = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1).substr(1, 2).try_cast("int")
    return F.when(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1).rlike(r"^\d\d") & zone.between(1, 19), zone)


def sprite_id(code: Column) -> Column:
    return F.concat(F.lit("dm-"), code.cast("string"))


def recolored_sprite_id(sprite: Column, color: Column) -> Column:
    return F.concat(base_sprite_id(sprite), F.lit("--"), F.lower(F.ltrim(color, F.lit("#"))))


def base_sprite_id(sprite: Column) -> Column:
    return F.regexp_replace(sprite, r"--[0-9a-f]{6}$", "")


def icon_class(name: Column, known: Column) -> Column:
    """What an icon file stands for: digits of a known code are supported, other digits unused, the rest custom."""
    return F.when(~name.rlike(r"^\d+$"), "custom").when(known, "supported").otherwise("unused")


def style_label(level: Column) -> Column:
    return F.concat(F.lit("Level "), F.regexp_extract(level.cast("string"), r"(\d+)", 1))


def is_hex_color(color: Column) -> Column:
    return color.rlike(r"^#[0-9a-fA-F]{6}$")


def hex_to_rgb(color: Column) -> Column:
    part = lambda k: F.conv(F.substring(color, k, 2), 16, 10).cast("int")
    return F.when(is_hex_color(color), F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b")))


def csv_field(text: Column) -> Column:
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def valid_layer_name(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9_-]+$")


def safe_relative_path(path: Column) -> Column:
    """Neither absolute nor with back-slashes, empty, ``.`` or ``..`` parts."""
    bad = F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))
    return (path != "") & ~path.contains("\\") & ~path.startswith("/") & ~bad
