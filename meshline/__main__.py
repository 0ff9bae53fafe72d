"""``python -m meshline IN OUT [--format pmtiles --layer-name N ...]``; exit codes as in ``convert.exit_code``."""

from __future__ import annotations

import argparse
import sys

from meshline.plans import convert


def options(argv: list[str]) -> convert.Options:
    p = argparse.ArgumentParser(prog="meshline", exit_on_error=False)
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--format", choices=("gpkg", "pmtiles"), default="gpkg")
    p.add_argument("--layer-name")
    p.add_argument("--code", type=int, action="append", default=[])
    p.add_argument("--type", action="append", default=[], choices=("polygon", "line", "circle", "arc", "point", "direction", "text"))
    p.add_argument("--encoding", default="shift_jis")
    p.add_argument("--zone", type=int)
    p.add_argument("--zone-from-name", action="store_true")
    p.add_argument("--batch", type=int, default=convert.geopackage.BATCH)
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--keep-gpkg", action="store_true")
    try:
        a, rest = p.parse_known_args(argv)
    except argparse.ArgumentError as e:
        raise convert.InputError(str(e)) from e
    if rest:
        raise convert.InputError(f"unknown options: {' '.join(rest)}")
    return convert.Options(a.input, a.output, a.format, a.layer_name, a.code, a.type, a.encoding, a.zone, a.zone_from_name, a.batch, a.overwrite, a.keep_gpkg)


def main(argv: list[str]) -> int:
    summary, error = None, None
    try:
        o = options(argv)
        convert.validate(o)
        from pyspark.sql import SparkSession

        summary = convert.convert(SparkSession.builder.appName("meshline").getOrCreate(), o)
        print(convert.summary_line(summary), file=sys.stderr)
    except Exception as e:
        error = e
        print(f"error: {e}", file=sys.stderr)
    return convert.exit_code(error, summary)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
