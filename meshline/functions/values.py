"""Small functions of numbers, times, ranges and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres for each unit of a survey file's coordinates, by unit code. Fixed values of the format.
UNITS = {1: 0.001, 10: 0.01}


def unit_of(code: Column) -> Column:
    return F.when(code == 1, 0.001).when(code == 10, 0.01).otherwise(1.0)


def fraction_unit(level: Column) -> Column:
    return F.when(level < 2500, 0.001).otherwise(0.01)


def rotation(kind: Column, angle: Column) -> Column:
    """Degrees clockwise for symbols: of texts the negative angle, else from north."""
    return F.pmod(F.when(kind == "text", -angle).otherwise(F.lit(90.0) - angle), F.lit(360.0))


def mm_on_map(mm: Column | float, level: Column) -> Column:
    return (F.lit(mm) if isinstance(mm, float | int) else mm) * level / 1000.0


def round_away(v: Column) -> Column:
    """To the nearest whole number, halves away from zero."""
    return F.when(v >= 0, F.floor(v + 0.5)).otherwise(F.ceil(v - 0.5)).cast("int")


def duration(seconds: Column) -> Column:
    """s.mmm below a minute, then minutes and seconds, then hours."""
    whole = F.floor(seconds).cast("long")
    return (
        F.when(seconds < 60, F.concat(F.format_string("%.3f", seconds), F.lit("s")))
        .when(whole < 3600, F.format_string("%dm %02ds", F.floor(whole / 60), whole % 60))
        .otherwise(F.format_string("%dh %02dm %02ds", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60))
    )


def eta(elapsed: Column, done: Column, whole: Column) -> Column:
    """Seconds left at the pace so far; null where nothing is done or more than everything."""
    return F.when((done > 0) & (whole >= done), elapsed * (whole - done) / done)


def completion_clock(now: Column, seconds: Column) -> Column:
    return F.date_format(now + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")), "HH:mm:ss")


def iso_now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def byte_range(header: Column, size: Column) -> Column:
    """struct(start, end) of one range of a file; null where the header is not such a range or lies outside."""
    pattern = r"^bytes=(\d*)-(\d*)$"
    a = F.regexp_extract(header, pattern, 1).try_cast("long")
    b = F.regexp_extract(header, pattern, 2).try_cast("long")
    start = F.when(a.isNull(), F.greatest(size - b, F.lit(0))).otherwise(a)
    end = F.when(a.isNull() | b.isNull(), size - 1).otherwise(F.least(b, size - 1))
    ok = header.rlike(pattern) & (a.isNotNull() | (b > 0)) & (start <= end) & (start < size)
    return F.when(ok, F.struct(start.alias("start"), end.alias("end")))


def content_type(path: Column) -> Column:
    kinds = {"html": "text/html; charset=utf-8", "js": "text/javascript; charset=utf-8", "css": "text/css; charset=utf-8", "json": "application/json; charset=utf-8", "png": "image/png", "svg": "image/svg+xml", "pbf": "application/x-protobuf", "pmtiles": "application/octet-stream"}
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit("application/octet-stream")
    for k, v in kinds.items():
        out = F.when(extension == k, v).otherwise(out)
    return out


def route(path: Column, prefixes: dict[str, str]) -> Column:
    """struct(root, rest) of a request's path by the longest prefix it begins with; null where it has none."""
    out = F.lit(None).cast("struct<root:string,rest:string>")
    for prefix in sorted(prefixes, key=len):
        out = F.when(path.startswith(prefix), F.struct(F.lit(prefixes[prefix]).alias("root"), F.substr(path, F.lit(len(prefix) + 1)).alias("rest"))).otherwise(out)
    return out


def query_value(query: Column, name: str) -> Column:
    """The first value of a parameter of a URL's query, decoded; null where it is not there."""
    found = F.regexp_extract_all(query, F.lit(rf"(?:^|[?&]){name}=([^&#]*)"), F.lit(1))
    return F.try_url_decode(F.get(found, F.lit(0)))


def camera(query: Column) -> Column:
    """lon, lat and scale of ``coords=lon,lat&scale=n``; parts out of range are null."""
    number = r"(-?\d+(?:\.\d+)?)"
    lon = F.regexp_extract(query, rf"(?:^|[?&])coords={number},{number}(?:&|$)", 1).try_cast("double")
    lat = F.regexp_extract(query, rf"(?:^|[?&])coords={number},{number}(?:&|$)", 2).try_cast("double")
    scale = F.regexp_extract(query, rf"(?:^|[?&])scale={number}(?:&|$)", 1).try_cast("double")
    ok = lon.between(-180, 180) & lat.between(-90, 90)
    return F.struct(F.when(ok, lon).alias("lon"), F.when(ok, lat).alias("lat"), F.when(scale > 0, scale).alias("scale"))


def map_state(lon: Column, lat: Column, scale: Column, layers: Column) -> Column:
    """The URL parameters of a map's state."""
    return F.concat(F.lit("coords="), F.format_string("%.6f,%.6f", lon, lat), F.lit("&scale="), scale.cast("string"), F.when(F.size(layers) > 0, F.concat(F.lit("&layers="), F.array_join(F.transform(layers, F.url_encode), ","))).otherwise(""))


def last_page(total: Column, size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / size)).cast("long")
