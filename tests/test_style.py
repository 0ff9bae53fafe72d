from pyspark.sql import functions as F

from meshline.functions import names, values
from meshline.operators import featurequery, style
from meshline.sources import manifest

DOC = {
    "version": 8,
    "sources": {"dm": {"type": "vector", "url": ""}},
    "layers": [
        {"id": "base", "type": "line", "source": "dm", "source-layer": "dm_default_line", "filter": ["==", ["get", "LEVEL"], 2500], "paint": {"line-color": "#000000"}},
        {"id": "label", "type": "symbol", "source": "dm", "source-layer": "dm_8110_text", "layout": {"text-field": ["get", "TEXT"]}},
    ],
}


def test_visibility_is_idempotent(spark):
    once = style.visible(style.rows(spark, DOC))
    assert once.orderBy("ord").collect() == style.visible(once).orderBy("ord").collect()
    assert once.where("id = 'base'").first()["filter"] == '["all",["==",["get","LEVEL"],2500],["!=",["coalesce",["get","DMSKIP"],0],1]]'


def test_colours_visibility_and_round_trip(spark):
    layers = style.set_visibility(style.set_color(style.rows(spark, DOC), "#ff0000", kind="line"), "base", False)
    out = style.document(layers, DOC)["layers"][0]
    assert out["paint"]["line-color"] == "#ff0000" and out["layout"]["visibility"] == "none"
    assert style.document(style.rows(spark, DOC), DOC)["layers"][0]["filter"] == DOC["layers"][0]["filter"]
    assert '"TEXT_VERTICAL"' in style.vertical_labels(style.rows(spark, DOC), F.lit(True)).where("id = 'label'").first()["layout"]


def test_runtime_layers_match_by_prefix(spark):
    a = spark.createDataFrame([("line",), ("line-a",)], "id string")
    b = spark.createDataFrame([("line-a-1",), ("line",), ("lines",)], "id string")
    assert {tuple(r) for r in style.runtime_layers(a, b).collect()} == {("line", "line-a-1"), ("line-a", "line-a-1"), ("line", "line")}


def test_documents_and_manifests():
    run = style.runtime_document(DOC, "a.pmtiles", "s", "g", {"type": "raster"}, ["base"])
    assert run["layers"][0]["id"] == "basemap" and run["sources"]["dm"]["url"] == "pmtiles://a.pmtiles" and run["layers"][1]["layout"]["visibility"] == "none"
    found = manifest.of_style(style.bundled_document(DOC, "survey", 2500, [130, 30, 140, 40]))
    assert found["pmtiles"] == "survey.pmtiles" and found["sourceLayers"] == ["dm_8110_text"] and found["bounds"] == [130, 30, 140, 40]


def test_names_and_values(spark):
    one = spark.range(1).select(
        F.array(*(names.padded_code(F.lit(x)) for x in ("7", " 2100 ", "12345", "a"))).alias("codes"), names.recolored_sprite_id(F.lit("dm-1--00ff00"), F.lit("#AB0102")).alias("sprite"), names.hex_to_rgb(F.lit("#0a0B0c")).alias("rgb"), names.csv_field(F.lit('a"b,c')).alias("csv"),
        F.array(*(values.duration(F.lit(x)) for x in (0.5, 125.0, 3723.0))).alias("d"), values.camera(F.lit("?coords=139.7,35.6&scale=2500")).alias("cam"), values.eta(F.lit(10.0), F.lit(5.0), F.lit(10.0)).alias("eta"),
        F.array(*(F.to_json(values.byte_range(F.lit(h), F.lit(100))) for h in ("bytes=10-19", "bytes=90-", "bytes=-10", "bytes=5-1", "items=0-1", "bytes=200-"))).alias("r"),
        F.array(*(values.content_type(F.lit(p)) for p in ("a.pbf", "b.unknown"))).alias("t"), values.map_state(F.lit(139.5), F.lit(35.0), F.lit(2500), F.array(F.lit("a b"))).alias("url"),
    ).first()
    assert one["codes"] == ["0007", "2100", "", ""] and one["sprite"] == "dm-1--ab0102" and tuple(one["rgb"]) == (10, 11, 12) and one["csv"] == '"a""b,c"'
    assert one["d"] == ["0.500s", "2m 05s", "1h 02m 03s"] and tuple(one["cam"]) == (139.7, 35.6, 2500.0) and one["eta"] == 10.0
    assert one["r"] == ['{"start":10,"end":19}', '{"start":90,"end":99}', '{"start":90,"end":99}', None, None, None]
    assert one["t"] == ["application/x-protobuf", "application/octet-stream"] and one["url"] == "coords=139.500000,35.000000&scale=2500&layers=a+b"


def test_query_problems(spark):
    cases = [("dm_2100_line", "1", None, []), ("bad", "0", "101", ["layer", "page", "pageSize"]), ("dm_2100_line", "x", "50", ["page"])]
    rows = spark.createDataFrame([c[:3] for c in cases], "l string, p string, s string")
    assert [r["q"] for r in rows.select(featurequery.query_problems(F.col("l"), F.col("p"), F.col("s")).alias("q")).collect()] == [c[3] for c in cases]
