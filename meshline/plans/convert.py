"""Whole conversions: survey files to a GeoPackage, and either to tiles with a manifest.

Parsed features are written once as Parquet in a working folder and every
later step reads those, so files are framed once however many outputs follow.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshline.functions import names, projection
from meshline.operators import decorations, features, layers, mvt, tiles
from meshline.sinks import folders, geopackage, pmtiles
from meshline.sources import geopackage as source
from meshline.sources import manifest, survey


class InputError(ValueError):
    """What the caller asked for cannot be done; exit code 2."""


@dataclass
class Options:
    input: str
    output: str
    format: str = "gpkg"
    layer_name: str | None = None
    codes: list[int] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    encoding: str = "shift_jis"
    zone: int | None = None
    zone_from_name: bool = False
    batch: int = geopackage.BATCH
    overwrite: bool = False
    keep_gpkg: bool = False
    zooms: tuple[int, int] = tiles.ZOOMS


def validate(o: Options) -> None:
    """Everything that can be known before work begins."""
    if not os.path.exists(o.input):
        raise InputError(f"no such input: {o.input}")
    if o.format not in ("gpkg", "pmtiles"):
        raise InputError(f"unknown format: {o.format}")
    if o.batch <= 0:
        raise InputError("the batch size must be above 0")
    if o.zone is not None and not 1 <= o.zone <= 19:
        raise InputError("zones are 1 to 19")
    gpkg = is_geopackage(o.input)
    if o.format == "gpkg":
        if gpkg or o.layer_name:
            raise InputError("GeoPackage output takes survey files and no layer name")
        if not o.output.lower().endswith(".gpkg"):
            raise InputError("the output must end in .gpkg")
    else:
        if not o.layer_name or not re.fullmatch(r"[A-Za-z0-9_-]+", o.layer_name):
            raise InputError("tiles need a layer name of letters, digits, - and _")
        if gpkg and (o.codes or o.types):
            raise InputError("filters apply to survey files")
    if not gpkg and os.path.isfile(o.input) and not o.input.lower().endswith(".dm"):
        raise InputError(f"not a survey file: {o.input}")
    if os.path.exists(o.output) and not o.overwrite:
        raise InputError(f"the output exists: {o.output}")
    if not os.path.isdir(os.path.dirname(os.path.abspath(o.output))):
        raise InputError(f"no such folder: {os.path.dirname(o.output)}")


def is_geopackage(path: str) -> bool:
    return path.lower().endswith(".gpkg") and os.path.isfile(path)


def parse(spark: SparkSession, o: Options, work: str) -> DataFrame:
    """All events of the input, staged."""
    found = features.events(survey.frame(survey.files(spark, o.input), o.zone, o.zone_from_name), o.encoding)
    found.write.parquet(f"{work}/events")
    return spark.read.parquet(f"{work}/events")


def prepare(events: DataFrame, o: Options, work: str) -> tuple[DataFrame, DataFrame]:
    """Included features with ids and flat points, and their decorations with theirs; both staged."""
    spark = events.sparkSession

    def stage(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    kept = features.include(events.where("event = 'feature'"), o.codes, o.types)
    base = stage(features.output_points(layers.with_user_ids(kept)), "base")
    deco = stage(decorations.with_source(decorations.decorate(base)).withColumnRenamed("user_id", "source_user_id"), "decorated")
    # Numbered like features, by file, line and place, in each decoration layer.
    keyed = deco.withColumns({"own_kind": F.col("kind"), "own_line": F.col("source_line"), "kind": F.concat_ws("+", "kind", "deco_kind"), "source_line": F.struct("source_line", "deco_index")})
    numbered = layers.with_user_ids(keyed).drop("kind", "source_line").withColumnsRenamed({"own_kind": "kind", "own_line": "source_line"})
    return base, stage(numbered, "decorations")


def _layer_rows(base: DataFrame, deco: DataFrame) -> list[dict]:
    """One row per output table; what the catalogue names has a table even without a symbol. As many rows as layers."""
    own = layers.keys(base).select("layer", "kind", "srs_id", F.lit(False).alias("decoration"))
    keys = decorations.layer_keys(base)
    named = keys.select(names.layer_name(F.col("dmcode"), F.col("kind"), F.col("zone"), F.col("map_level"), F.col("deco_kind")).alias("layer"), F.col("deco_kind").alias("kind"), F.coalesce(projection.zone_to_epsg(F.col("zone")), F.lit(-1)).alias("srs_id"), F.lit(True).alias("decoration"))
    return [r.asDict() for r in own.unionByName(named).orderBy("layer").collect()]


def _rows(base: DataFrame, deco: DataFrame) -> DataFrame:
    """Rows of all tables: layer, ord, pts and attributes by column name."""
    upper = ("dmfigtype", "dmmove", "dmskip", "dmattr", "dmprec", "dmyymm", "dmregion", "dminfo", "dmelemid", "dmattrkind", "dmupyymm", "dmdelyymm")
    key = [F.col(c) for c in layers.KEY]
    none = lambda kind: F.lit(None).cast(kind)
    whole = {"USER_ID": F.col("user_id"), "DMCODE": F.col("dmcode"), "LEVEL": F.col("map_level"), **{c.upper(): F.col(c) for c in upper}, "LINENO": F.col("line_no"), "VERTICAL": F.col("vertical")}
    attributes = F.struct(*(v.cast("long").alias(k) for k, v in whole.items()), F.col("dmattrdata").alias("DMATTRDATA"), F.col("source_file").alias("DMFILE"), F.col("angle").alias("ANGLE"), F.col("size").alias("SIZE"), F.col("char_spacing").alias("CHARSPACING"), F.col("text").alias("TEXT"), none("string").alias("SRC_LAYER"), none("long").alias("SRC_USER_ID"), none("string").alias("SRC_DMFILE"), none("long").alias("SRC_DMCODE"), none("string").alias("DECORATION"), none("long").alias("DECO_INDEX"))
    a = base.select(names.layer_name(*key).alias("layer"), F.col("user_id").alias("ord"), "pts", attributes.alias("attributes"))
    known = [f.name for f in a.schema["attributes"].dataType.fields]
    types = {f.name: f.dataType for f in a.schema["attributes"].dataType.fields}
    given = {"USER_ID": F.col("user_id"), "SRC_LAYER": F.col("src_layer"), "SRC_USER_ID": F.col("source_user_id"), "SRC_DMFILE": F.col("src_dmfile"), "SRC_DMCODE": F.col("src_dmcode"), "DECORATION": F.col("decoration"), "DECO_INDEX": F.col("deco_index")}
    b = deco.select("layer", F.col("user_id").alias("ord"), "pts", F.struct(*(given.get(k, F.lit(None)).cast(types[k]).alias(k) for k in known)).alias("attributes"))
    return a.unionByName(b)


def to_geopackage(spark: SparkSession, o: Options, path: str, work: str) -> dict[str, int]:
    """Survey files to one GeoPackage; returns the run's summary."""
    events = parse(spark, o, work)
    counts = features.parser_summary(events).first().asDict()
    base, deco = prepare(events, o, work)
    found = _layer_rows(base, deco)
    if not found:
        raise InputError("no feature is left")
    geopackage.write(_rows(base, deco), found, path, o.batch, f"{work}/packed")
    return {"features": base.count(), "warnings": counts["warnings"], "skipped": counts["skipped"], "layers": len(found), "tiles": 0}


def tile_input(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(layers, features) of a GeoPackage, features as tiles hold them."""
    catalog = source.checked_catalog(spark, path)
    rows = source.features(spark, path)
    deco = F.col("layer.deco_kind").isNotNull()
    flat = rows.select(
        F.col("table_name").alias("table"), F.col("fid").alias("ord"), F.col("layer.source_layer").alias("source_layer"), "kind", F.col("layer.zone").alias("zone"), F.col("layer.level").alias("map_level"), F.col("geometry.pts").alias("pts"), F.col("geometry.error").alias("error"),
        F.col("USER_ID").alias("user_id"), F.when(deco, F.col("SRC_DMCODE")).otherwise(F.col("DMCODE")).alias("dmcode"), F.when(deco, F.col("SRC_DMFILE")).otherwise(F.col("DMFILE")).alias("source_file"), *(F.col(c).alias(c.lower()) for c in mvt.INT_TAGS), F.col("DMATTRDATA").alias("dmattrdata"),
        F.col("ANGLE").alias("angle"), F.col("SIZE").alias("size"), F.col("CHARSPACING").alias("char_spacing"), F.col("LINENO").alias("line_no"), F.col("VERTICAL").alias("vertical"), F.col("TEXT").alias("text"),
        F.col("SRC_LAYER").alias("src_layer"), F.col("SRC_USER_ID").alias("src_user_id"), F.col("SRC_DMFILE").alias("src_dmfile"), F.col("SRC_DMCODE").alias("src_dmcode"), F.col("DECORATION").alias("decoration"), F.col("DECO_INDEX").alias("deco_index"),
    )
    sound = flat.withColumn("pts", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("pts"))).drop("error")
    return catalog, sound


def to_tiles(spark: SparkSession, o: Options, gpkg: str, folder: str, work: str) -> dict[str, int]:
    """A GeoPackage to {layer}.pmtiles and manifest.json in ``folder``."""
    catalog, rows = tile_input(spark, gpkg)
    rows.write.parquet(f"{work}/features")
    rows = spark.read.parquet(f"{work}/features")
    counts = rows.groupBy(F.col("table").alias("table_name")).agg(F.count("*").alias("features"))
    boxes = catalog.join(counts, "table_name", "left").select(F.col("table_name").alias("layer"), "zone", F.col("layer.level").alias("map_level"), F.coalesce("features", F.lit(0)).alias("features"), "min_x", "max_x", "min_y", "max_y")
    summary = tiles.dataset_summary(boxes).first()
    if not summary["features"]:
        raise InputError("no feature is left")
    bounds = (summary["west"], summary["south"], summary["east"], summary["north"])
    tiled = tiles.in_candidates(tiles.feature_tiles(mvt.tagged(tiles.project(rows)), o.zooms), tiles.candidates(boxes, o.zooms))
    mvt.tiles(mvt.tile_layers(tiled)).write.parquet(f"{work}/tiles")
    done = spark.read.parquet(f"{work}/tiles")
    archive = f"{o.layer_name}.pmtiles"
    meta = pmtiles.metadata(o.layer_name, o.zooms, bounds, summary["source_layers"])
    written = pmtiles.write(done.select("z", "x", "y", "data"), f"{folder}/{archive}", meta, bounds, o.zooms)
    with open(f"{folder}/manifest.json", "w", encoding="utf-8") as f:
        f.write(manifest.to_json(o.layer_name, archive, summary["levels"], summary["source_layers"], bounds))
    return {"features": summary["features"], "warnings": 0, "skipped": 0, "layers": boxes.count(), "tiles": written["addressed"], "non_empty_tiles": done.where(F.length("data") > 0).count()}


@contextmanager
def staging(spark: SparkSession, local: str) -> Iterator[str]:
    """A folder for staged tables, gone afterwards: in the shared folder the cluster names, or else in a local one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    folder = f"{shared.rstrip('/')}/convert-{uuid.uuid4().hex}" if shared else f"{local}/staged"
    try:
        yield folder
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def convert(spark: SparkSession, o: Options) -> dict[str, int]:
    """Runs a conversion; the output appears whole or not at all. A GeoPackage that is read must lie where executors see it."""
    validate(o)
    with tempfile.TemporaryDirectory(dir=os.path.dirname(os.path.abspath(o.output))) as local, staging(spark, local) as work:
        gpkg, counts = o.input, {"warnings": 0, "skipped": 0}
        if not is_geopackage(o.input):
            gpkg = f"{local}/out.gpkg"
            counts = to_geopackage(spark, o, gpkg, f"{work}/parsed")
        if o.format == "gpkg":
            os.replace(gpkg, o.output)
            return counts
        folder = f"{local}/folder"
        os.makedirs(folder)
        summary = to_tiles(spark, o, gpkg, folder, f"{work}/tiled") | {k: counts[k] for k in ("warnings", "skipped")}
        if o.keep_gpkg:
            shutil.copyfile(gpkg, f"{folder}/{o.layer_name}.gpkg")
        folders.replace_folder(folder, o.output)
        return summary


def summary_line(s: dict[str, int]) -> str:
    return "features: {features}, warnings: {warnings}, skipped: {skipped}, layers: {layers}, tiles: {tiles}".format(**s)


def exit_code(error: BaseException | None, s: dict[str, int] | None) -> int:
    """0 done, 1 done with skipped records, 2 wrong input, 3 failed."""
    if isinstance(error, InputError):
        return 2
    if error is not None:
        return 3
    return 1 if s and s["skipped"] else 0

