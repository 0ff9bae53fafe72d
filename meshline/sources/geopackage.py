"""GeoPackage files as a Spark data source: one partition per layer table, read-only."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from meshline.functions import names, projection
from meshline.functions.blobs import from_blob

#: Columns a feature table may have besides fid and geom; those it lacks are null.
COLUMNS = (
    *((c, "long") for c in ("USER_ID", "DMCODE", "LEVEL", "DMFIGTYPE", "DMMOVE", "DMSKIP", "DMATTR", "DMPREC", "DMYYMM", "DMREGION", "DMINFO", "DMELEMID", "DMATTRKIND", "DMUPYYMM", "DMDELYYMM")),
    ("DMATTRDATA", "string"), ("DMFILE", "string"), ("ANGLE", "double"), ("SIZE", "double"), ("CHARSPACING", "double"), ("LINENO", "long"), ("VERTICAL", "long"), ("TEXT", "string"),
    ("SRC_LAYER", "string"), ("SRC_USER_ID", "long"), ("SRC_DMFILE", "string"), ("SRC_DMCODE", "long"), ("DECORATION", "string"), ("DECO_INDEX", "long"),
)
FEATURES = "table_name string, fid long, geom binary, " + ", ".join(f"{c} {t}" for c, t in COLUMNS)
#: Rows of a table that are read at once.
READ = 5000
CATALOG = "table_name string, geometry_type string, srs_id int, min_x double, min_y double, max_x double, max_y double, column_name string"
CATALOG_SQL = """SELECT c.table_name, g.geometry_type_name, g.srs_id, c.min_x, c.min_y, c.max_x, c.max_y, g.column_name
FROM gpkg_contents c JOIN gpkg_geometry_columns g ON g.table_name = c.table_name WHERE c.data_type = 'features' ORDER BY c.table_name"""


def connect(path: str) -> sqlite3.Connection:
    """A read-only connection; nothing is created or written beside the file."""
    path = path.removeprefix("file://").removeprefix("file:")
    return sqlite3.connect(f"file:{quote(os.path.abspath(path))}?mode=ro", uri=True)


def _ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _batch(name: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows (fid, geometry and all columns) of a table in Arrow's form; values of another type than the column's end the query."""
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    types = [pa.int64(), pa.binary(), *(kinds[t] for _, t in COLUMNS)]
    arrays = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *arrays], ["table_name", "fid", "geom", *(c for c, _ in COLUMNS)])


@dataclass
class Table(InputPartition):
    name: str
    geometry: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, what: str, tables: list[str] | None):
        self.path, self.what, self.tables = path, what, tables

    def partitions(self) -> list[InputPartition]:
        if self.what == "catalog":
            return [Table("", "")]
        with connect(self.path) as db:
            found = [Table(r[0], r[7]) for r in db.execute(CATALOG_SQL) if self.tables is None or r[0] in self.tables]
        return found or [Table("", "")]

    def read(self, part: Table) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        with connect(self.path) as db:
            if self.what == "catalog":
                yield from db.execute(CATALOG_SQL)
            elif part.name:
                have = {r[1] for r in db.execute(f"PRAGMA table_info({_ident(part.name)})")}
                picked = ", ".join(_ident(c) if c in have else "NULL" for c, _ in COLUMNS)
                rows = db.execute(f"SELECT fid, {_ident(part.geometry)}, {picked} FROM {_ident(part.name)} ORDER BY fid")
                while held := rows.fetchmany(READ):
                    yield _batch(part.name, held)


class GeoPackageSource(DataSource):
    """Options: path, what (catalog or features), tables (comma-separated allow-list)."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> str:
        return CATALOG if self.options.get("what") == "catalog" else FEATURES

    def reader(self, schema) -> _Reader:
        tables = self.options.get("tables")
        return _Reader(self.options["path"], self.options.get("what", "features"), tables.split(",") if tables else None)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Feature tables with what their names say; ``layer`` is null for tables of other programs."""
    rows = spark.createDataFrame(list(_Reader(path, "catalog", None).read(Table("", ""))), CATALOG)  # as many as layers
    return rows.withColumn("layer", names.parse_table(F.col("table_name"))).withColumn("zone", projection.epsg_to_zone(F.col("srs_id")))


def checked_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalog; ends the query at a table that is no layer of ours or has no zone."""
    bad = F.col("layer").isNull() | F.col("zone").isNull()
    message = F.concat(F.lit("unsupported layer: "), F.col("table_name"))
    return catalog(spark, path).withColumn("table_name", F.when(bad, F.raise_error(message)).otherwise(F.col("table_name")))


def features(spark: SparkSession, path: str, tables: list[str] | None = None) -> DataFrame:
    """The features of all tables, or of some, with geometry as points.

    Tables are listed here and read by the data source's reader, a task for
    each; Spark would plan the source itself in Python processes of its own
    beside the driver, which hold more memory than the driver's Python.
    """
    reader = _Reader(path, "features", tables)
    parts = [(p.name, p.geometry) for p in reader.partitions()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                yield from reader.read(Table(part["name"], part["geometry"]))

    listed = spark.createDataFrame(spark.sparkContext.parallelize(parts, len(parts)), "name string, geometry string")
    rows = listed.mapInArrow(run, FEATURES).withColumn("layer", names.parse_table(F.col("table_name"))).where("layer is not null")
    kind = F.coalesce("layer.deco_kind", "layer.kind")
    return rows.withColumn("kind", kind).withColumn("geometry", from_blob(F.col("geom"), F.col("kind"))).drop("geom")
