"""Manifests of published layers, and style documents from which one can be derived."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshline.functions import names

VERSION = 1
SCHEMA = "version int, layerName string, pmtiles string, levels array<int>, sourceLayers array<string>, bounds array<double>, center array<double>, styles array<string>"


def problems(m: Column) -> Column:
    """What is wrong with a manifest (a struct of SCHEMA), in order; empty if nothing."""
    b, c = m["bounds"], m["center"]
    get = lambda a, k: F.get(a, F.lit(k))
    checks = [
        (~m["version"].eqNullSafe(F.lit(VERSION)), "version"),
        (~F.coalesce(names.valid_layer_name(m["layerName"]), F.lit(False)), "layerName"),
        (~F.coalesce(names.safe_relative_path(m["pmtiles"]) & m["pmtiles"].endswith(".pmtiles"), F.lit(False)), "pmtiles"),
        (F.coalesce(F.size(m["levels"]), F.lit(-1)) < 1, "levels"),
        (F.coalesce(F.exists(m["levels"], lambda v: v.isNull() | (v <= 0)), F.lit(False)), "levels"),
        (F.coalesce(F.size(m["sourceLayers"]), F.lit(-1)) < 1, "sourceLayers"),
        (F.coalesce(F.exists(m["sourceLayers"], lambda v: v.isNull() | ~names.valid_layer_name(v)), F.lit(False)), "sourceLayers"),
        (~F.coalesce((F.size(b) == 4) & get(b, 0).between(-180, 180) & get(b, 2).between(-180, 180) & get(b, 1).between(-90, 90) & get(b, 3).between(-90, 90) & (get(b, 0) < get(b, 2)) & (get(b, 1) < get(b, 3)), F.lit(False)), "bounds"),
        (~F.coalesce((F.size(c) == 3) & get(c, 0).between(-180, 180) & get(c, 1).between(-90, 90) & get(c, 2).between(0, 24), F.lit(False)), "center"),
        (F.coalesce(F.exists(m["styles"], lambda v: v.isNull() | ~names.safe_relative_path(v)), F.lit(False)), "styles"),
    ]
    return F.array_distinct(F.filter(F.array(*(F.when(bad, F.lit(name)) for bad, name in checks)), lambda v: v.isNotNull()))


def to_json(layer: str, pmtiles: str, levels: list[int], source_layers: list[str], bounds: tuple[float, float, float, float]) -> str:
    center = [(bounds[0] + bounds[2]) / 2, (bounds[1] + bounds[3]) / 2, 15]
    return json.dumps({"version": VERSION, "layerName": layer, "pmtiles": pmtiles, "levels": levels, "sourceLayers": source_layers, "bounds": list(bounds), "center": center}, indent=2, ensure_ascii=False) + "\n"


def of_style(style: dict) -> dict:
    """The manifest that a bundled style document implies."""
    urls = [s.get("url", "") for s in style.get("sources", {}).values() if str(s.get("url", "")).startswith("pmtiles://")]
    if not urls:
        raise ValueError("the style has no archive")
    used = dict.fromkeys(x["source-layer"] for x in style.get("layers", []) if x.get("source-layer") and not x["source-layer"].startswith("dm_default_"))
    level = style.get("metadata", {}).get("dm:level", 2500)
    found = {"version": VERSION, "layerName": style.get("name", "layer"), "pmtiles": re.sub(r"^.*/", "", urls[0].removeprefix("pmtiles://")), "levels": [int(level)], "sourceLayers": list(used), "styles": ["style.json"]}
    if "bounds" in style.get("metadata", {}):
        found["bounds"] = style["metadata"]["bounds"]
    return found


def read(folder: str) -> dict:
    """The manifest of a published folder: manifest.json, else what style.json implies; a style beside a manifest is named in it."""
    manifest, style = os.path.join(folder, "manifest.json"), os.path.join(folder, "style.json")
    if os.path.exists(manifest):
        with open(manifest, encoding="utf-8") as f:
            found = json.load(f)
        return found | ({"styles": ["style.json"]} if os.path.exists(style) else {})
    with open(style, encoding="utf-8") as f:
        return of_style(json.load(f))
