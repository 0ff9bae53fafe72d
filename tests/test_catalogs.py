import pytest
from pyspark.sql import functions as F

from meshline.__main__ import main, options
from meshline.operators import catalogs
from meshline.plans import convert


def test_options():
    o = options(["in", "out", "--format", "pmtiles", "--layer-name", "n", "--code", "1", "--code", "2", "--type", "arc"])
    assert (o.input, o.output, o.format, o.layer_name, o.codes, o.types) == ("in", "out", "pmtiles", "n", [1, 2], ["arc"])
    for wrong in (["in"], ["in", "out", "--format", "x"], ["in", "out", "--what"], ["in", "out", "--batch", "x"]):
        with pytest.raises((convert.InputError, SystemExit)):
            options(wrong)
    assert main(["/none", "/tmp/none.gpkg"]) == 2


def test_lists_icons_and_progress(spark):
    layers = spark.createDataFrame([("dm_10_line", "line"), ("dm_2_line", "line"), ("dm_1_point", "point")], "name string, kind string")
    assert {r["kind"]: r["names"] for r in catalogs.by_kind(layers).collect()} == {"line": ["dm_2_line", "dm_10_line"], "point": ["dm_1_point"]}
    assert [tuple(r) for r in catalogs.layer_options(layers, "line", " DM_ ", "dm_10_line").collect()] == [("", False), ("dm_2_line", False), ("dm_10_line", True)]
    found = catalogs.icons(spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", "a.png"), ("b", "b.png")], "id string, file string"), spark.createDataFrame([("b", 8, 9)], "id string, width int, height int"))
    assert [tuple(r) for r in catalogs.icon_order(found, ("b",)).collect()] == [("b", "b.png", 8, 9), ("a", "a.png", 32, 32)]
    steps = spark.createDataFrame([("r", 1, 1.0, 10.0), ("r", 2, 3.0, 30.0)], "run string, n int, weight double, elapsed double")
    assert [r["left_s"] for r in catalogs.progress(steps).orderBy("n").collect()] == [30.0, 0.0]
    assert spark.range(1).select(catalogs.geometry_group(F.lit("MultiLineString")).alias("g")).first()["g"] == "line"
