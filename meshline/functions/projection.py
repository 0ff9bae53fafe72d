"""Plane-rectangular zones, geographic degrees and Web Mercator as closed-form Columns (Krueger's series to the sixth order)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshline.functions.geometry import let

#: Origins of the nineteen zones: latitude, longitude in degrees. Fixed values of the public coordinate system.
ZONE_ORIGINS: tuple[tuple[float, float], ...] = (
    (33.0, 129.5), (33.0, 131.0), (36.0, 132.0 + 10 / 60), (33.0, 133.5), (36.0, 134.0 + 20 / 60), (36.0, 136.0), (36.0, 137.0 + 10 / 60), (36.0, 138.5), (36.0, 139.0 + 50 / 60), (40.0, 140.0 + 50 / 60),
    (44.0, 140.25), (44.0, 142.25), (44.0, 144.25), (26.0, 142.0), (26.0, 127.5), (26.0, 124.0), (26.0, 131.0), (20.0, 136.0), (26.0, 154.0),
)
EPSG_BASE = 6668
RADIUS, SCALE = 6378137.0, 0.9999
HALF_WORLD = math.pi * RADIUS
#: Series of the GRS80 ellipsoid. Fixed values.
BETA = (8.377321681620353e-4, 5.905870210368961e-8, 1.6734826899173422e-10, 2.16479808256513e-13, 3.787978139134215e-16, 7.248749104244059e-19)
DELTA = (3.3565514856043126e-3, 6.571873263127178e-6, 1.7646404372866217e-8, 5.387753890009473e-11, 1.7640075159133893e-13, 6.056074055207586e-16)
RECTIFYING = 6367449.145771048
#: Meridian arcs from the equator to the zones' latitudes, in metres.
ARCS = {20.0: 2212366.2541029816, 26.0: 2876834.572518374, 33.0: 3652748.0430750945, 36.0: 3985542.6702962522, 40.0: 4429529.030236589, 44.0: 4873822.36959616}


def _by_zone(zone: Column, values: list[float]) -> Column:
    return F.get(F.array(*map(F.lit, values)), zone - 1)


def zone_to_epsg(zone: Column) -> Column:
    return F.when(zone.between(1, 19), zone.cast("int") + EPSG_BASE).otherwise(F.lit(-1))


def epsg_to_zone(srs: Column) -> Column:
    return F.when((srs - EPSG_BASE).between(1, 19), (srs - EPSG_BASE).cast("int"))


def to_degrees(zone: Column, x: Column, y: Column) -> Column:
    """struct(lon, lat) of easting x and northing y; null outside the zones."""
    lon0, arc = _by_zone(zone, [o[1] for o in ZONE_ORIGINS]), _by_zone(zone, [ARCS[o[0]] for o in ZONE_ORIGINS])
    xi, eta = (y / SCALE + arc) / RECTIFYING, x / (SCALE * RECTIFYING)

    def solve(v: Column) -> Column:
        xi, eta = v["xi"], v["eta"]
        p, q = xi, eta
        for j, b in enumerate(BETA, 1):
            p, q = p - F.sin(2 * j * xi) * F.cosh(2 * j * eta) * b, q - F.cos(2 * j * xi) * F.sinh(2 * j * eta) * b
        return F.struct(p.alias("p"), q.alias("q"))

    def place(v: Column) -> Column:
        lat = v["chi"]
        for j, d in enumerate(DELTA, 1):
            lat = lat + F.sin(2 * j * v["chi"]) * d
        return F.struct((lon0 + F.degrees(F.atan2(F.sinh(v["q"]), F.cos(v["p"])))).alias("lon"), F.degrees(lat).alias("lat"))

    turned = let(F.struct(xi.alias("xi"), eta.alias("eta")), solve)
    solved = let(let(turned, lambda v: F.struct(F.asin(F.sin(v["p"]) / F.cosh(v["q"])).alias("chi"), v["p"].alias("p"), v["q"].alias("q"))), place)
    return F.when(zone.between(1, 19), solved)


def degrees_to_mercator(lon: Column, lat: Column) -> Column:
    return F.struct((F.radians(lon) * RADIUS).alias("x"), (F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * RADIUS).alias("y"))


def to_mercator(zone: Column, x: Column, y: Column) -> Column:
    return let(to_degrees(zone, x, y), lambda d: F.when(d.isNotNull(), degrees_to_mercator(d["lon"], d["lat"])))


def mercator_to_degrees(x: Column, y: Column) -> Column:
    return F.struct(F.degrees(x / RADIUS).alias("lon"), F.degrees(F.atan(F.exp(y / RADIUS)) * 2 - math.pi / 2).alias("lat"))


def zoom_of_scale(scale: Column, lat: Column) -> Column:
    """Zoom of a 512-pixel world at 96 dots per inch."""
    return F.log2(F.cos(F.radians(lat)) * (2 * math.pi * RADIUS * 96 * 39.37 / 512) / scale)


def scale_of_zoom(zoom: Column, lat: Column) -> Column:
    return F.round(F.cos(F.radians(lat)) * (2 * math.pi * RADIUS * 96 * 39.37 / 512) / F.pow(F.lit(2.0), zoom)).cast("long")
