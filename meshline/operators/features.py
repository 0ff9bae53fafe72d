"""Records to events: features, metadata and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshline.functions import geometry as G
from meshline.functions import text as T
from meshline.functions.fixedwidth import CODE_FIELDS, first_error, fw_double, fw_int, header_fields

#: Coordinate fields as they stand in a row.
RAW = "struct<y:double,x:double,z:double>"
#: Columns of an event, in order.
EVENT_COLUMNS = (
    "path", "source_file", "source_line", "event", "zone", "map_level", "dmcode", "kind", "gtype", "pts", "center", "radius", "start_angle", "end_angle", "clockwise",
    *CODE_FIELDS, "dmattrdata", "angle", "size", "char_spacing", "line_no", "vertical", "text", "message", "skipped",
)


def raw_coordinates(rows: Column, dimensions: Column, count: Column) -> Column:
    """The coordinate fields of data rows: six points (Y, X) or four (Y, X, Z) to a row of seven-byte fields; a missing row gives a null point."""
    per_row = F.when(dimensions == 2, 6).otherwise(4)

    def one(i: Column) -> Column:
        row, at = F.get(rows, F.floor(i / per_row).cast("int")), ((i % per_row) * dimensions * 7).cast("int")
        return F.when(row.isNotNull(), F.struct(fw_double(row, at, 7).alias("y"), fw_double(row, at + 7, 7).alias("x"), F.when(dimensions == 3, fw_double(row, at + 14, 7)).alias("z")))

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count.cast("int") - 1), one)).otherwise(F.array().cast(f"array<{RAW}>"))


def placed(raw: Column, mesh: Column) -> Column:
    """Coordinates in metres: the mesh's origin and the fields times its unit."""
    return F.transform(raw, lambda p: F.struct((mesh["x"] + p["x"] * mesh["unit"]).alias("x"), (mesh["y"] + p["y"] * mesh["unit"]).alias("y"), (p["z"] * mesh["unit"]).alias("z")))


def _coordinate_error(raw: Column, dimensions: Column) -> Column:
    """The first point's error decides, as if points were read one by one."""
    bad = F.filter(raw, lambda p: p.isNull() | p["y"].isNull() | p["x"].isNull() | ((dimensions == 3) & p["z"].isNull()))
    first = F.get(bad, F.lit(0))
    return F.when(
        F.size(bad) > 0,
        F.when(first.isNull(), "coordinate record is missing").when(first["y"].isNull(), "invalid Y coordinate").when(first["x"].isNull(), "invalid X coordinate").otherwise("invalid Z coordinate"),
    )


def elements(records: DataFrame, encoding: str = "shift_jis") -> DataFrame:
    """Element records with their fields, geometry and, where they are wrong, the message that says why."""
    e = records.where(F.col("tag").rlike("^E[0-9]$"))
    h = F.col("header")
    e = e.withColumns({f"_{k}": v for k, v in header_fields(h).items()}).withColumn("_type", F.substring("tag", 2, 1))
    e = e.withColumn("_dims", F.when(F.col("_following").isin(0, 2), 2).when(F.col("_following").isin(3, 6), 3))
    count = F.greatest(F.col("_data_count"), F.lit(0))
    e = e.withColumn("_raw", F.when(F.col("_type").isin("1", "2", "3", "4", "6") & F.col("_dims").isNotNull(), raw_coordinates(F.col("rows"), F.col("_dims"), count)))
    e = e.withColumns({"_pts": placed(F.col("_raw"), F.col("mesh")), "_wrong": _coordinate_error(F.col("_raw"), F.col("_dims")), "_x": F.col("mesh.x") + fw_double(h, 42, 7) * F.col("mesh.unit"), "_y": F.col("mesh.y") + fw_double(h, 35, 7) * F.col("mesh.unit")})
    three = F.when(F.col("_type").isin("3", "4") & (F.size("_pts") == 3), G.circumcircle(*(F.get("_pts", F.lit(k)) for k in range(3))))
    e = e.withColumn("_circle", three)
    many = F.col("_type").isin("1", "2", "3", "4", "6")
    direct = F.col("_type").isin("5", "7", "8")
    message = first_error(
        [
            (F.col("mesh").isNull(), "element encountered before mesh record"),
            (F.col("_dmcode").isNull(), "invalid DMCODE"),
            (F.col("_following").isNull(), "invalid following record type"),
            (F.col("_data_count").isNull(), "invalid data count"),
            (F.col("_type").isin("0", "9"), F.concat(F.lit("unsupported element type E"), F.col("_type"))),
            (many & F.col("_dims").isNull(), F.concat(F.lit("unsupported coordinate type "), F.col("_following").cast("string"))),
            (many & F.col("_wrong").isNotNull(), F.col("_wrong")),
            (many & (F.size("_raw") == 0), "element contains no coordinates"),
            (F.col("_type").isin("3", "4") & (F.size("_pts") != 3), F.concat(F.lit("circle/arc requires 3 points, got "), F.size("_pts").cast("string"))),
            (F.col("_type").isin("3", "4") & F.col("_circle").isNull(), "circle points are collinear"),
            ((F.col("_type") == "5") & (F.col("_data_count") > 0), "point collections are not supported"),
            ((F.col("_type") == "6") & (F.size("_pts") < 2), "direction requires two coordinates"),
            (direct & F.col("_x").isNull(), "invalid X"),
            (direct & F.col("_y").isNull(), "invalid Y"),
            ((F.col("_type") == "7") & (F.size("rows") == 0), "annotation row is missing"),
        ]
    )
    row = F.get("rows", F.lit(0))
    kind7, kind8 = F.col("_type") == "7", F.col("_type") == "8"
    c, p = F.col("_circle"), lambda k: F.get("_pts", F.lit(k))
    center = F.when(c.isNotNull(), G.point(c["cx"], c["cy"]))
    angle_of = lambda k: F.when((F.col("_type") == "4") & c.isNotNull(), G.direction(G.point(c["cx"], c["cy"]), p(k)))
    z = F.lit(None).cast("double").alias("z")
    single = F.array(F.struct(F.col("_x").alias("x"), F.col("_y").alias("y"), z))
    annotation_type = F.coalesce("_annotation_type", F.lit(2))
    return e.withColumn("_message", message).select(
        "path", "source_file", F.col("line").alias("source_line"), "zone", F.col("level").alias("map_level"), F.col("_dmcode").alias("dmcode"),
        F.when(F.col("_type") == "1", "polygon").when(F.col("_type").isin("2", "3", "4"), "line").when(kind7, "text").otherwise("point").alias("kind"),
        F.when(F.col("_type") == "1", "polygon").when(F.col("_type") == "2", "line").when(F.col("_type") == "3", "circle").when(F.col("_type") == "4", "arc").when(kind7, "text").otherwise("point").alias("gtype"),
        F.when(F.col("_type") == "1", G.close_ring(F.col("_pts"))).when(F.col("_type") == "6", F.slice("_pts", 1, 1)).when(direct, single).otherwise(F.col("_pts")).alias("pts"),
        center.alias("center"), c["radius"].alias("radius"), angle_of(0).alias("start_angle"), angle_of(2).alias("end_angle"),
        F.when(F.col("_type") == "4", G.clockwise(angle_of(0), angle_of(1), angle_of(2))).alias("clockwise"),
        *(F.col(f"_{k}").alias(k) for k in CODE_FIELDS),
        F.when(kind8, T.trimmed_or_null(T.decode_annotation(F.when(kind8, T.attribute_bytes(F.col("rows"))), F.lit(2), encoding))).alias("dmattrdata"),
        F.when(F.col("_type") == "6", G.direction(p(0), p(1))).when(kind7, fw_double(row, 1, 7)).alias("angle"),
        F.when(kind7, fw_double(row, 8, 5)).alias("size"), F.when(kind7, fw_double(row, 13, 5)).alias("char_spacing"),
        F.when(kind7, fw_int(row, 18, 2)).alias("line_no"), F.when(kind7, fw_int(row, 0, 1)).alias("vertical"),
        F.when(kind7, T.decode_annotation(F.when(kind7, T.annotation_bytes(F.col("rows"), count, annotation_type)), annotation_type, encoding)).alias("text"),
        F.col("_message").alias("message"),
    )


def events(records: DataFrame, encoding: str = "shift_jis") -> DataFrame:
    """Features, metadata and warnings of framed records, in one frame with ``event``."""
    bad = F.col("message").isNotNull()
    e = elements(records, encoding).withColumns({"event": F.when(bad, "warning").otherwise("feature"), "skipped": bad})
    framing = records.select("path", "source_file", F.col("line").alias("source_line"), F.explode("warnings").alias("w")).select("path", "source_file", "source_line", "w.message", "w.skipped", F.lit("warning").alias("event"))
    metadata = records.where("tag = 'I '").select("path", "source_file", F.col("line").alias("source_line"), "zone", F.lit("metadata").alias("event"), F.lit(False).alias("skipped"))
    out = e.unionByName(framing, allowMissingColumns=True).unionByName(metadata, allowMissingColumns=True)
    return out.select(*EVENT_COLUMNS)


def code_filter(codes: list[int] | None) -> Column:
    """Keeps all where no codes are given."""
    return F.col("dmcode").isin(*codes) if codes else F.lit(True)


def type_filter(types: list[str] | None) -> Column:
    """Keeps the given geometry types; a point with an angle is a direction."""
    if not types:
        return F.lit(True)
    of = {
        "polygon": F.col("gtype") == "polygon", "line": F.col("gtype") == "line", "circle": F.col("gtype") == "circle", "arc": F.col("gtype") == "arc", "text": F.col("gtype") == "text",
        "point": (F.col("gtype") == "point") & F.col("angle").isNull(), "direction": (F.col("gtype") == "point") & F.col("angle").isNotNull(),
    }
    if unknown := set(types) - set(of):
        raise ValueError(f"unknown feature types: {sorted(unknown)}")
    out = F.lit(False)
    for t in types:
        out = out | of[t]
    return out


def include(features: DataFrame, codes: list[int] | None = None, types: list[str] | None = None) -> DataFrame:
    return features.where(code_filter(codes) & type_filter(types))


def output_points(f: DataFrame) -> DataFrame:
    """``f`` with ``pts`` as they are written: circles and arcs as lines."""
    flat = F.transform("pts", lambda p: G.point(p["x"], p["y"]))
    sweep = G.arc_sweep(F.col("start_angle"), F.col("end_angle"), F.col("clockwise"))
    cx, cy, r = F.col("center.x"), F.col("center.y"), F.col("radius")
    return f.withColumn("pts", F.when(F.col("gtype") == "circle", G.circle_points(cx, cy, r)).when(F.col("gtype") == "arc", G.arc_points(cx, cy, r, F.col("start_angle"), sweep)).otherwise(flat))


def parser_summary(found: DataFrame) -> DataFrame:
    """Numbers of features, warnings and skipped records."""
    return found.agg(F.count_if(F.col("event") == "feature").alias("features"), F.count_if(F.col("event") == "warning").alias("warnings"), F.count_if((F.col("event") == "warning") & F.col("skipped")).alias("skipped"))


def same_warnings(scanned: DataFrame, converted: DataFrame) -> DataFrame:
    """One row: the numbers of warnings of two passes over the same files, and whether they are equal, as they must be."""
    each = scanned.select("event", F.lit(0).alias("run")).unionByName(converted.select("event", F.lit(1).alias("run"))).where("event = 'warning'")
    return each.agg(F.count_if(F.col("run") == 0).alias("scanned"), F.count_if(F.col("run") == 1).alias("converted")).withColumn("equal", F.col("scanned") == F.col("converted"))
