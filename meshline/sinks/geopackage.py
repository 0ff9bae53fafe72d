"""GeoPackage files. One file has one writer, the driver: rows are sorted, made into blobs, envelopes and values by the executors, and come to it as packed batches, a partition at a time."""

from __future__ import annotations

import os
import pickle
import re
import sqlite3
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

from meshline.functions.blobs import write_blobs

BATCH = 10_000
#: Names and kinds of columns. Fixed values of the file format.
BASE = (
    ("USER_ID", "INTEGER NOT NULL"), *((c, "INTEGER") for c in ("DMCODE", "LEVEL", "DMFIGTYPE", "DMMOVE", "DMSKIP", "DMATTR", "DMPREC", "DMYYMM", "DMREGION", "DMINFO", "DMELEMID", "DMATTRKIND", "DMUPYYMM", "DMDELYYMM")),
    ("DMATTRDATA", "TEXT"), ("DMFILE", "TEXT NOT NULL"),
)
TEXT = (("ANGLE", "REAL"), ("SIZE", "REAL"), ("CHARSPACING", "REAL"), ("LINENO", "INTEGER"), ("VERTICAL", "INTEGER"), ("TEXT", "TEXT"))
DECORATION = (("USER_ID", "INTEGER NOT NULL"), ("SRC_LAYER", "TEXT NOT NULL"), ("SRC_USER_ID", "INTEGER NOT NULL"), ("SRC_DMFILE", "TEXT NOT NULL"), ("SRC_DMCODE", "INTEGER NOT NULL"), ("DECORATION", "TEXT NOT NULL"), ("DECO_INDEX", "INTEGER NOT NULL"))
#: 64 MB of pages and sorts in files: rows come layer by layer, so that a larger cache only holds what is done with.
PRAGMAS = "PRAGMA page_size=8192; PRAGMA cache_size=-65536; PRAGMA temp_store=FILE; PRAGMA journal_mode=WAL; PRAGMA synchronous=NORMAL; PRAGMA foreign_keys=ON; PRAGMA application_id=1196444487; PRAGMA user_version=10300;"
METADATA = """
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER REFERENCES gpkg_spatial_ref_sys(srs_id));
CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL UNIQUE REFERENCES gpkg_contents(table_name), column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL REFERENCES gpkg_spatial_ref_sys(srs_id), z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
CREATE TABLE gpkg_extensions (table_name TEXT, column_name TEXT, extension_name TEXT NOT NULL, definition TEXT NOT NULL, scope TEXT NOT NULL, UNIQUE (table_name, column_name, extension_name));
INSERT INTO gpkg_spatial_ref_sys VALUES ('Undefined cartesian SRS', -1, 'NONE', -1, 'undefined', 'undefined cartesian coordinate reference system');
INSERT INTO gpkg_spatial_ref_sys VALUES ('Undefined geographic SRS', 0, 'NONE', 0, 'undefined', 'undefined geographic coordinate reference system');
"""
GEOMETRY = {"polygon": "POLYGON", "line": "LINESTRING"}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Writer:
    """One GeoPackage under construction. Leaves nothing behind when it fails."""

    def __init__(self, path: str, layers: list[dict]):
        """``layers``: layer, kind (of its geometry), srs_id, decoration (whether it is one)."""
        if os.path.exists(path):
            raise FileExistsError(path)
        self.path, self.layers = path, {x["layer"]: x for x in layers}
        self.db = sqlite3.connect(path, isolation_level=None)
        self.db.executescript(PRAGMAS + METADATA)
        for srs in sorted({x["srs_id"] for x in layers} - {-1, 0}):
            self.db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?,?,'EPSG',?,'undefined',NULL)", (f"EPSG:{srs}", srs, srs))
        for x in layers:
            name, columns = x["layer"], self._columns(x)
            self.db.execute(f"CREATE TABLE {quoted(name)} (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB NOT NULL, {', '.join(f'{quoted(c)} {t}' for c, t in columns)})")
            self.db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?,'features',?,?)", (name, name, x["srs_id"]))
            self.db.execute("INSERT INTO gpkg_geometry_columns VALUES (?,'geom',?,?,0,0)", (name, GEOMETRY.get(x["kind"], "POINT"), x["srs_id"]))
            self.db.execute(f"CREATE VIRTUAL TABLE {quoted('rtree_' + name + '_geom')} USING rtree(id, minx, maxx, miny, maxy)")
        self.boxes: dict[str, list[float]] = {}
        self.counts = dict.fromkeys(self.layers, 0)

    @staticmethod
    def _columns(layer: dict) -> tuple[tuple[str, str], ...]:
        angle = (("ANGLE", "REAL"),) if layer["kind"] == "point" else ()
        if layer.get("decoration"):
            return (*DECORATION, *angle)
        return (*BASE, *(TEXT if layer["kind"] == "text" else angle))

    def write(self, layer: str, rows: list[tuple], boxes: list[tuple]) -> None:
        """Rows (geom and the layer's columns) and their envelopes, in the open transaction."""
        first = self.counts[layer] + 1
        columns = ["fid", "geom", *(c for c, _ in self._columns(self.layers[layer]))]
        self.db.executemany(f"INSERT INTO {quoted(layer)} ({', '.join(map(quoted, columns))}) VALUES ({', '.join('?' * len(columns))})", ((fid, *r) for fid, r in enumerate(rows, first)))
        self.db.executemany(f"INSERT INTO {quoted('rtree_' + layer + '_geom')} VALUES (?,?,?,?,?)", ((fid, *b) for fid, b in enumerate(boxes, first)))
        x0, x1, y0, y1 = zip(*boxes, strict=True)
        old = self.boxes.get(layer, boxes[0])
        self.boxes[layer] = [min(old[0], *x0), max(old[1], *x1), min(old[2], *y0), max(old[3], *y1)]
        self.counts[layer] += len(rows)

    def finish(self) -> None:
        for name, layer in self.layers.items():
            for c in ("SRC_USER_ID",) if layer.get("decoration") else ("DMCODE",):
                self.db.execute(f"CREATE INDEX {quoted(f'idx_{name}_{c}')} ON {quoted(name)} ({quoted(c)})")
            self._triggers(name)
            self.db.execute("INSERT INTO gpkg_extensions VALUES (?,'geom','gpkg_rtree_index','http://www.geopackage.org/spec120/#extension_rtree','write-only')", (name,))
            if box := self.boxes.get(name):
                self.db.execute("UPDATE gpkg_contents SET min_x=?, max_x=?, min_y=?, max_y=?, last_change=strftime('%Y-%m-%dT%H:%M:%fZ','now') WHERE table_name=?", (*box, name))
        self.db.executescript("PRAGMA optimize; PRAGMA wal_checkpoint(TRUNCATE);")
        self.db.close()

    def _triggers(self, name: str) -> None:
        """The six triggers of the R-tree extension; the host that edits the file brings the ST_ functions."""
        t, r = quoted(name), quoted(f"rtree_{name}_geom")
        full, gone = "(NEW.geom NOT NULL AND NOT ST_IsEmpty(NEW.geom))", "(NEW.geom IS NULL OR ST_IsEmpty(NEW.geom))"
        put = f"INSERT OR REPLACE INTO {r} VALUES (NEW.fid, ST_MinX(NEW.geom), ST_MaxX(NEW.geom), ST_MinY(NEW.geom), ST_MaxY(NEW.geom));"
        drop = f"DELETE FROM {r} WHERE id=OLD.fid;"
        for suffix, when, what in (
            ("insert", f"AFTER INSERT ON {t} WHEN {full}", put),
            ("update1", f"AFTER UPDATE OF geom ON {t} WHEN OLD.fid=NEW.fid AND {full}", put),
            ("update2", f"AFTER UPDATE OF geom ON {t} WHEN OLD.fid=NEW.fid AND {gone}", drop),
            ("update3", f"AFTER UPDATE ON {t} WHEN OLD.fid<>NEW.fid AND {full}", drop + put),
            ("update4", f"AFTER UPDATE ON {t} WHEN OLD.fid<>NEW.fid AND {gone}", f"DELETE FROM {r} WHERE id IN (OLD.fid, NEW.fid);"),
            ("delete", f"AFTER DELETE ON {t} WHEN OLD.geom NOT NULL", drop),
        ):
            self.db.execute(f"CREATE TRIGGER {quoted(f'rtree_{name}_geom_{suffix}')} {when} BEGIN {what} END")

    def abort(self) -> None:
        self.db.close()
        for suffix in ("", "-wal", "-shm"):
            if os.path.exists(self.path + suffix):
                os.remove(self.path + suffix)


def packed(rows: DataFrame, layers: list[dict], batch: int) -> DataFrame:
    """(layer, n, data): sorted ``rows`` (layer, pts, attributes struct) as pickled lists of rows and envelopes, ``batch`` rows at most to each."""
    by_name = {x["layer"]: (x, [c for c, _ in Writer._columns(x)]) for x in layers}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            names, pts, attributes = held.column("layer").to_pylist(), held.column("pts"), held.column("attributes")
            changes = [k for k in range(1, len(names)) if names[k] != names[k - 1]]
            starts = [0, *changes, len(names)] if names else []
            for begin, end in zip(starts, starts[1:], strict=False):
                layer, columns = by_name[names[begin]]
                for a in range(begin, end, batch):
                    n = min(batch, end - a)
                    part = pts.slice(a, n)
                    sizes = np.asarray(part.value_lengths().fill_null(0), dtype=np.int64)
                    if not sizes.all():
                        raise ValueError(f"a feature of {names[begin]} has no points")
                    flat = part.flatten()
                    x, y = (np.asarray(flat.field(c), dtype=np.float64) for c in ("x", "y"))
                    first = np.cumsum(sizes) - sizes
                    boxes = np.stack([f.reduceat(v, first) for v in (x, y) for f in (np.minimum, np.maximum)], axis=1)
                    own = attributes.slice(a, n)
                    values = [own.field(own.type.get_field_index(c)).to_pylist() for c in columns]
                    rows = list(zip(write_blobs(layer["kind"], x, y, sizes, boxes, layer["srs_id"]), *values, strict=True))
                    data = pickle.dumps((rows, list(map(tuple, boxes.tolist()))), 5)
                    yield pa.RecordBatch.from_arrays([pa.array([names[begin]]), pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["layer", "n", "data"])

    return rows.mapInArrow(run, "layer string, n long, data binary")


def in_order(rows: DataFrame, staged: str | None) -> Iterator[dict]:
    """Packed rows one by one: from a folder that the driver sees as files, where they are written first, or else through Spark.

    Results that Spark fetches are held in buffers outside the driver's heap,
    which stay and grow with the largest partitions.
    """
    folder = re.sub("^file:/+", "/", staged or "")
    if not folder.startswith("/"):
        yield from (r.asDict() for r in rows.toLocalIterator(prefetchPartitions=True))
        return
    rows.write.parquet(staged)
    for name in sorted((f for f in os.listdir(folder) if f.startswith("part-")), key=lambda f: int(f.split("-")[1])):
        for held in pq.ParquetFile(f"{folder}/{name}").iter_batches(1):
            yield from held.to_pylist()


def write(rows: DataFrame, layers: list[dict], path: str, batch: int = BATCH, staged: str | None = None) -> dict[str, int]:
    """Writes ``rows`` (layer, ord, pts, attributes struct) in order; returns the number of rows per layer.

    The driver holds a transaction of ``batch`` rows; ``staged`` is a folder for
    packed rows, see ``in_order``. A failure removes the file.
    """
    if batch <= 0:
        raise ValueError("the batch size must be above 0")
    writer = Writer(path, layers)
    try:
        open_rows = 0
        for r in in_order(packed(rows.orderBy("layer", "ord").select("layer", "pts", "attributes"), layers, batch), staged):
            if open_rows and open_rows + r["n"] > batch:
                writer.db.execute("COMMIT")
                open_rows = 0
            if not open_rows:
                writer.db.execute("BEGIN")
            writer.write(r["layer"], *pickle.loads(r["data"]))
            open_rows += r["n"]
        if open_rows:
            writer.db.execute("COMMIT")
        writer.finish()
    except BaseException:
        writer.abort()
        raise
    return writer.counts
