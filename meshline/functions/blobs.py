"""GeoPackage geometry blobs: little-endian header with an envelope, then two-dimensional WKB."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WKB = {"POLYGON": 3, "LINESTRING": 2, "POINT": 1, "polygon": 3, "line": 2, "point": 1, "text": 1}
MOST_POINTS = 1_000_000


def write_blob(kind: str, pts: list[tuple[float, float]], srs: int) -> bytes:
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    code = WKB[kind]
    head = b"GP\x00\x03" + struct.pack("<i4d", srs, min(xs), max(xs), min(ys), max(ys)) + b"\x01" + struct.pack("<I", code)
    flat = struct.pack(f"<{2 * len(pts)}d", *(v for p in pts for v in p))
    if code == 1:
        return head + flat[:16]
    return head + (struct.pack("<I", 1) if code == 3 else b"") + struct.pack("<I", len(pts)) + flat


def write_blobs(kind: str, x: np.ndarray, y: np.ndarray, sizes: np.ndarray, boxes: np.ndarray, srs: int) -> list[bytes]:
    """The blobs of many geometries of one kind: all points together, how many each has, and envelopes (min_x, max_x, min_y, max_y)."""
    code, flat, envelopes = WKB[kind], np.stack([x, y], axis=1).astype("<f8").tobytes(), boxes.astype("<f8").tobytes()
    head = b"GP\x00\x03" + struct.pack("<i", srs)
    shape = b"\x01" + struct.pack("<I", code) + (struct.pack("<I", 1) if code == 3 else b"")
    out = []
    ends = np.cumsum(sizes)
    for k, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
        count = b"" if code == 1 else struct.pack("<I", b - a)
        out.append(head + envelopes[32 * k : 32 * k + 32] + shape + count + flat[16 * a : 16 * (a + 1 if code == 1 else b)])
    return out


def span(blob: bytes | None, kind: str) -> tuple[int, int, int]:
    """(srs, place of the first point, number of points); raises ValueError where the blob is not what the kind says."""
    if not blob or blob[:2] != b"GP" or len(blob) < 8:
        raise ValueError("not a GeoPackage geometry")
    if not blob[3] & 1:
        raise ValueError("not little-endian")
    srs = struct.unpack_from("<i", blob, 4)[0]
    at = 8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}.get(blob[3] >> 1 & 7, 1 << 30)
    if len(blob) < at + 5 or blob[at] != 1:
        raise ValueError("not little-endian WKB")
    code = struct.unpack_from("<I", blob, at + 1)[0]
    if code != WKB[kind]:
        raise ValueError(f"geometry type {code} does not match {kind}")
    at += 5
    if code == 1:
        n = 1
    else:
        if code == 3:
            if len(blob) < at + 4 or struct.unpack_from("<I", blob, at)[0] != 1:
                raise ValueError("polygons have one ring")
            at += 4
        if len(blob) < at + 4:
            raise ValueError("geometry is cut off")
        n = struct.unpack_from("<I", blob, at)[0]
        at += 4
    if n > MOST_POINTS or n > (len(blob) - at) // 16:
        raise ValueError("coordinate count is too large")
    return srs, at, n


def read_blob(blob: bytes | None, kind: str) -> tuple[int, list[tuple[float, float]]]:
    """(srs, points); raises ValueError where the blob is not what the kind says."""
    srs, at, n = span(blob, kind)
    v = struct.unpack_from(f"<{2 * n}d", blob, at)
    return srs, list(zip(v[::2], v[1::2], strict=True))


def to_blob(kind: Column, pts: Column, srs: Column) -> Column:
    @F.pandas_udf("binary")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for kinds, points, systems in batches:
            yield pd.Series([None if p is None or not len(p) else write_blob(k, [(q["x"], q["y"]) for q in p], int(s)) for k, p, s in zip(kinds, points, systems, strict=True)], dtype=object)

    return run(kind, F.transform(pts, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))), srs)


def from_blob(blob: Column, kind: Column) -> Column:
    """struct(error, srs, pts) of each blob; a bad one has its error and no points."""

    @F.arrow_udf("struct<error:string,srs:int,pts:array<struct<x:double,y:double>>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for blobs, kinds in batches:
            errors, systems, sizes, found = [], [], [], []
            for b, k in zip(blobs.to_pylist(), kinds.to_pylist(), strict=True):
                try:
                    srs, at, n = span(b, k)
                    errors.append(None)
                    systems.append(srs)
                    sizes.append(n)
                    found.append(b[at : at + 16 * n])
                except ValueError as e:
                    errors.append(str(e))
                    systems.append(None)
                    sizes.append(0)
            xy = np.frombuffer(b"".join(found), dtype="<f8").reshape(-1, 2)
            bad = np.array([e is not None for e in errors], dtype=bool)
            points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"])
            offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
            pts = pa.ListArray.from_arrays(pa.array(offsets), points, mask=pa.array(bad)) if len(bad) else pa.array([], pa.list_(points.type))
            yield pa.StructArray.from_arrays([pa.array(errors, pa.string()), pa.array(systems, pa.int32()), pts], ["error", "srs", "pts"])

    return run(blob, kind)
