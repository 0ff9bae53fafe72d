"""Registered queries on names, requests, styles and lists, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meshline.functions import names, text, values
from meshline.functions.blobs import from_blob, to_blob
from meshline.operators import catalogs, features, featurequery, layers, style
from meshline.plans import derive as D
from meshline.plans.registry import query
from meshline.sources import survey

_PLACE = "SELECT c_custkey AS id, (c_custkey%4001)/10.0-200 AS lon, (c_custkey%201-100)::DOUBLE AS lat, c_custkey%7*500 AS scale FROM customer"


def _places(spark, d):
    k = F.col("c_custkey")
    return D.table(spark, d, "customer").select(k.alias("id"), ((k % 4001) / 10.0 - 200).alias("lon"), (k % 201 - 100).cast("double").alias("lat"), (k % 7 * 500).alias("scale"))


@query(f"WITH p AS ({_PLACE}) SELECT id, CASE WHEN lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 THEN round(lon,6)+0.0 END AS lon, CASE WHEN lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 THEN round(lat,6)+0.0 END AS lat, CASE WHEN scale > 0 THEN scale::DOUBLE END AS scale FROM p")
def url_camera(spark, d):
    asked = F.format_string("?coords=%.6f,%.6f&scale=%d", "lon", "lat", "scale")
    return _places(spark, d).select("id", values.camera(asked).alias("c")).select("id", (F.round("c.lon", 6) + 0.0).alias("lon"), (F.round("c.lat", 6) + 0.0).alias("lat"), "c.scale")


@query(f"WITH p AS ({_PLACE}) SELECT id, 'coords='||format('{{:.6f}},{{:.6f}}',lon,lat)||'&scale='||scale||CASE WHEN id%3>0 THEN '&layers='||CASE WHEN id%3=1 THEN 'dm_'||id||'_line' ELSE 'dm_'||id||'_line,dm_7_text' END ELSE '' END AS state FROM p")
def url_state(spark, d):
    one = F.concat(F.lit("dm_"), F.col("id").cast("string"), F.lit("_line"))
    shown = F.when(F.col("id") % 3 == 0, F.array().cast("array<string>")).when(F.col("id") % 3 == 1, F.array(one)).otherwise(F.array(one, F.lit("dm_7_text")))
    return _places(spark, d).select("id", values.map_state(F.col("lon"), F.col("lat"), F.col("scale"), shown).alias("state"))


@query("SELECT c_custkey AS id, CASE c_custkey%4 WHEN 0 THEN 'n '||c_custkey WHEN 1 THEN 'ä&b' WHEN 2 THEN '' END AS name FROM customer")
def query_values(spark, d):
    k = F.col("c_custkey")
    asked = F.when(k % 4 == 0, F.concat(F.lit("/f?page=1&name=n%20"), k.cast("string"), F.lit("&x=2"))).when(k % 4 == 1, "name=%C3%A4%26b#top").when(k % 4 == 2, "/f?name=&name=7").otherwise("/f?surname=1")
    return D.table(spark, d, "customer").select(k.alias("id"), values.query_value(asked, "name").alias("name"))


_PATHS = ("/assets/a.html", "/assets/tiles/b.PBF", "/c.json", "/assets/tiles/d.e/f", "other", "/assets/g.svg")


@query("""WITH p AS (SELECT c_custkey AS id, ['/assets/a.html','/assets/tiles/b.PBF','/c.json','/assets/tiles/d.e/f','other','/assets/g.svg'][1+c_custkey%6] AS p FROM customer)
SELECT id, CASE WHEN p LIKE '/assets/tiles/%' THEN 'tiles' WHEN p LIKE '/assets/%' THEN 'public' WHEN p LIKE '/%' THEN 'site' END AS root, CASE WHEN p LIKE '/assets/tiles/%' THEN p[15:] WHEN p LIKE '/assets/%' THEN p[9:] WHEN p LIKE '/%' THEN p[2:] END AS rest,
CASE id%6 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/x-protobuf' WHEN 2 THEN 'application/json; charset=utf-8' WHEN 5 THEN 'image/svg+xml' ELSE 'application/octet-stream' END AS kind FROM p""")
def path_routes(spark, d):
    k = F.col("c_custkey")
    p = D.table(spark, d, "customer").select(k.alias("id"), D.pick(_PATHS, k % 6).alias("p"))
    return p.withColumn("r", values.route(F.col("p"), {"/": "site", "/assets/": "public", "/assets/tiles/": "tiles"})).select("id", "r.root", "r.rest", values.content_type(F.col("p")).alias("kind"))


@query(f"WITH {D.SQL_LINES}, k AS (SELECT DISTINCT dmcode, zone, map_level FROM feat) SELECT 'dm_'||dmcode||'_line_'||lpad(zone::VARCHAR,2,'0')||'_'||map_level AS layer, row_number() OVER (ORDER BY dmcode, zone, map_level)::INT AS place FROM k")
def layer_order(spark, d):
    """Layers in the order of their tables. There are as many rows as layers."""
    return layers.keys(D.lines(spark, d)).select("layer", F.row_number().over(Window.orderBy(*layers.key_order())).cast("int").alias("place"))


@query("""WITH q AS (SELECT c_custkey AS id, ['dm_2101_line','dm_2101','dm_7100_point_deco_line','roads'][1+c_custkey%4] AS layer, ['1','0','x','7'][1+c_custkey//4%4] AS page, ['50',NULL,'101','-1'][1+c_custkey//16%4] AS size FROM customer)
SELECT id, array_to_string(list_filter([CASE WHEN layer IN ('dm_2101','roads') THEN 'layer' END, CASE WHEN page IN ('0','x') THEN 'page' END, CASE WHEN size IN ('101','-1') THEN 'pageSize' END], lambda v: v IS NOT NULL), ',') AS problems FROM q""")
def feature_query_problems(spark, d):
    k = F.col("c_custkey")
    layer, page = D.pick(("dm_2101_line", "dm_2101", "dm_7100_point_deco_line", "roads"), k % 4), D.pick(("1", "0", "x", "7"), F.floor(k / 4) % 4)
    size = D.pick(("50", None, "101", "-1"), F.floor(k / 16) % 4)
    return D.table(spark, d, "customer").select(k.alias("id"), F.array_join(featurequery.query_problems(layer, page, size), ",").alias("problems"))


_LAYERS = "l AS (SELECT DISTINCT 'dm_'||(1000+p_size*37%500)||'_'||k AS name, k AS kind FROM (SELECT p_size, CASE p_size%3 WHEN 0 THEN 'line' WHEN 1 THEN 'point' ELSE 'text' END AS k FROM part))"


def _layers(spark, d):
    s = F.col("p_size")
    kind = D.pick(("line", "point", "text"), s % 3)
    return D.table(spark, d, "part").select(F.concat(F.lit("dm_"), (s * 37 % 500 + 1000).cast("string"), F.lit("_"), kind).alias("name"), kind.alias("kind")).distinct()


@query(f"WITH {_LAYERS} SELECT name FROM l WHERE kind='line' AND contains(name, '_12')")
def layer_filter(spark, d):
    return featurequery.filter_layers(_layers(spark, d), "line", " _12 ").select("name")


@query(f"WITH {_LAYERS} SELECT kind, string_agg(name, ',' ORDER BY name) AS names FROM l GROUP BY kind")
def layers_by_kind(spark, d):
    return catalogs.by_kind(_layers(spark, d).select("name")).select("kind", F.array_join("names", ",").alias("names"))


@query(f"WITH {_LAYERS} SELECT '' AS name, false AS selected UNION ALL SELECT name, name = 'dm_1037_point' FROM l WHERE kind='point'")
def layer_choice(spark, d):
    return catalogs.layer_options(_layers(spark, d), "point", "", "dm_1037_point")


@query("SELECT 'dm-'||n_nationkey AS id, n_name AS file, CASE WHEN n_nationkey%2=0 THEN 16+n_nationkey ELSE 32 END::INT AS width, CASE WHEN n_nationkey%2=0 THEN 20 ELSE 32 END::INT AS height FROM nation")
def sprite_icons(spark, d):
    n = D.table(spark, d, "nation").select(names.sprite_id(F.col("n_nationkey")).alias("id"), F.col("n_name").alias("file"), F.col("n_nationkey").alias("k"))
    sizes = n.where("k % 2 = 0").select("id", (F.col("k") + 16).cast("int").alias("width"), F.lit(20).alias("height"))
    return catalogs.icons(n.select("id"), n.select("id", "file"), sizes)


@query("""WITH c AS (SELECT c_custkey AS id, '#'||lpad(to_hex((c_custkey*7919)%16777216), 6, '0') AS color FROM customer)
SELECT id, 'dm-'||(id%50)||'--'||lower(color[2:]) AS sprite, 'dm-'||(id%50) AS base, ('0x'||color[2:3])::INT AS r, ('0x'||color[4:5])::INT AS g, ('0x'||color[6:7])::INT AS b FROM c""")
def sprite_colors(spark, d):
    k = F.col("c_custkey")
    c = D.table(spark, d, "customer").select(k.alias("id"), F.concat(F.lit("#"), F.lpad(F.hex((k * 7919) % 16777216), 6, "0")).alias("color"))
    named = c.withColumn("sprite", names.recolored_sprite_id(names.sprite_id(F.col("id") % 50), F.col("color"))).withColumn("rgb", names.hex_to_rgb(F.col("color")))
    return named.select("id", "sprite", names.base_sprite_id(F.col("sprite")).alias("base"), "rgb.r", "rgb.g", "rgb.b")


@query("""SELECT p_partkey AS id, CASE WHEN p_size%3=0 THEN '"'||replace(t,'"','""')||'"' WHEN p_size%3=1 THEN '"'||t||'"' ELSE t END AS field, chr(39)||p_name||chr(39)||chr(39)||'s'||chr(39) AS literal FROM (SELECT *, CASE p_size%3 WHEN 0 THEN p_name||' "x"' WHEN 1 THEN p_name||',y' ELSE p_name END AS t FROM part)""")
def csv_fields(spark, d):
    s, n = F.col("p_size"), F.col("p_name")
    t = F.when(s % 3 == 0, F.concat(n, F.lit(' "x"'))).when(s % 3 == 1, F.concat(n, F.lit(",y"))).otherwise(n)
    return D.table(spark, d, "part").select(F.col("p_partkey").alias("id"), names.csv_field(t).alias("field"), names.quote_literal(F.concat(n, F.lit("'s"))).alias("literal"))


@query("SELECT p_partkey AS id, ['POLYGON','LINESTRING','POINT','POINT'][1+p_size%4] AS geometry, [3,2,1,1][1+p_size%4]::INT AS wkb, 'Level '||(p_size*100) AS label, CASE WHEN p_size%4=3 THEN 'custom' WHEN p_size%2=0 THEN 'supported' ELSE 'unused' END AS icon, p_size%5<>4 AS valid FROM part")
def layer_facts(spark, d):
    s = F.col("p_size")
    kind = D.pick(names.KINDS, s % 4)
    icon = names.icon_class(F.when(s % 4 == 3, "x1").otherwise(s.cast("string")), s % 2 == 0)
    valid = names.valid_layer_name(F.when(s % 5 == 4, "a b").otherwise("a_B-1"))
    return D.table(spark, d, "part").select(F.col("p_partkey").alias("id"), names.geometry_type(kind).alias("geometry"), names.wkb_type(kind).alias("wkb"), names.style_label(s * 100).alias("label"), icon.alias("icon"), valid.alias("valid"))


@query("""WITH s AS (SELECT o_custkey AS run, o_orderkey AS n, (1+o_orderkey%5)::DOUBLE AS weight, (o_orderkey%1000)::DOUBLE AS elapsed FROM orders),
w AS (SELECT *, sum(weight) OVER (PARTITION BY run ORDER BY n) AS done, sum(weight) OVER (PARTITION BY run) AS total FROM s) SELECT run, n, done, total, round(elapsed*(total-done)/done,6)+0.0 AS left_s FROM w""")
def weighted_progress(spark, d):
    k = F.col("o_orderkey")
    steps = D.table(spark, d, "orders").select(F.col("o_custkey").alias("run"), k.alias("n"), (k % 5 + 1).cast("double").alias("weight"), (k % 1000).cast("double").alias("elapsed"))
    return catalogs.progress(steps).select("run", "n", "done", "total", (F.round("left_s", 6) + 0.0).alias("left_s"))


@query("WITH b AS (SELECT DISTINCT 'dm-'||p_size AS base_id FROM part WHERE p_size%2=0), r AS (SELECT DISTINCT 'dm-'||p_size||CASE WHEN p_size%3=0 THEN '' ELSE '-x-'||p_size END AS running_id FROM part) SELECT base_id, running_id FROM b JOIN r ON running_id = base_id OR starts_with(running_id, base_id||'-')")
def runtime_layers(spark, d):
    s = F.col("p_size")
    p = D.table(spark, d, "part").select("p_size").distinct()
    name = F.concat(F.lit("dm-"), s.cast("string"))
    return style.runtime_layers(p.where(s % 2 == 0).select(name.alias("id")), p.select(F.when(s % 3 == 0, name).otherwise(F.concat(name, F.lit("-x-"), s.cast("string"))).alias("id")))


@query("""WITH f AS (SELECT c_custkey AS id, CASE c_custkey%3 WHEN 0 THEN 'line' WHEN 1 THEN 'point' ELSE 'polygon' END AS kind, c_custkey%5<>0 AS visible, (c_custkey%40)::DOUBLE AS x0, (c_custkey%40+c_custkey%9)::DOUBLE AS x1, (c_custkey%30)::DOUBLE AS y0, (c_custkey%30+c_custkey%8)::DOUBLE AS y1 FROM customer)
SELECT id, kind FROM f WHERE visible AND x0-CASE WHEN kind='line' THEN 6 ELSE 0 END <= 20 AND x1+CASE WHEN kind='line' THEN 6 ELSE 0 END >= 20 AND y0-CASE WHEN kind='line' THEN 6 ELSE 0 END <= 15 AND y1+CASE WHEN kind='line' THEN 6 ELSE 0 END >= 15""")
def clicked_features(spark, d):
    k = F.col("c_custkey")
    f = D.table(spark, d, "customer").select(k.alias("id"), k.alias("ord"), D.pick(("line", "point", "polygon"), k % 3).alias("kind"), (k % 5 != 0).alias("visible"), (k % 40).cast("double").alias("min_x"), (k % 40 + k % 9).cast("double").alias("max_x"), (k % 30).cast("double").alias("min_y"), (k % 30 + k % 8).cast("double").alias("max_y"))
    return featurequery.clicked(f, 20.0, 15.0).select("id", "kind")


@query(f"WITH {D.SQL_LINES} SELECT id, min_x=max_x AND min_y=max_y AS flat, round((min_x+max_x)/2,6)+0.0 AS x, round((min_y+max_y)/2,6)+0.0 AS y, CASE WHEN min_x=max_x AND min_y=max_y THEN greatest(14+id%6,18)::DOUBLE END AS zoom FROM feat")
def feature_navigation(spark, d):
    f = featurequery.as_feature(D.lines(spark, d).withColumns({"table_name": F.lit("t"), "fid": F.col("id")}), ["id"]).withColumn("key", F.col("properties")["id"].cast("long"))
    n = f.select(F.col("key").alias("id"), featurequery.navigation(F.col("bbox"), (F.col("key") % 6 + 14).cast("double")).alias("n"))
    return n.select("id", F.col("n.bounds").isNull().alias("flat"), (F.round("n.x", 6) + 0.0).alias("x"), (F.round("n.y", 6) + 0.0).alias("y"), F.col("n.zoom").alias("zoom"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS id FROM lineitem) SELECT CASE id%5 WHEN 1 THEN 'coordinate count is too large' WHEN 2 THEN 'not a GeoPackage geometry' WHEN 3 THEN 'geometry type 2 does not match polygon' WHEN 4 THEN 'not a GeoPackage geometry' END AS error, count(*)::BIGINT AS n FROM l GROUP BY 1""")
def blob_rejections(spark, d):
    """Blobs cut short, with a wrong mark, of another kind or missing."""
    k, b = F.col("id"), F.col("blob")
    f = D.lines(spark, d).select("id", to_blob(F.lit("line"), F.col("pts"), F.lit(6676)).alias("blob"))
    bad = F.when(k % 5 == 1, F.expr("substring(blob, 1, length(blob) - 1)")).when(k % 5 == 2, F.concat(F.unhex(F.lit("5858")), F.expr("substring(blob, 3)"))).when(k % 5 != 4, b)
    return f.select(from_blob(bad, F.when(k % 5 == 3, "polygon").otherwise("line"))["error"].alias("error")).groupBy("error").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, trim(p_name) AS text, CASE WHEN p_size%4=0 THEN NULL ELSE p_brand END AS attribute FROM part")
def annotation_texts(spark, d):
    """Annotation bytes out of an element's rows, and attribute texts without white space at their ends."""
    name, s = F.col("p_name"), F.col("p_size")
    whole = F.concat(name, F.lit("tail that the header does not count"))
    cells = F.array(*(F.concat(F.lit(" " * 20), F.rpad(F.substring(whole, 1 + 64 * r, 64), 64, " ")) for r in range(2)))
    body = text.annotation_bytes(cells, F.length(name), F.lit(2))
    loose = F.when(s % 4 == 0, "  　").otherwise(F.concat(F.lit(" 　"), F.col("p_brand"), F.lit("  ")))
    return D.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.trim(text.decode_annotation(body, F.lit(2))).alias("text"), text.trimmed_or_null(loose).alias("attribute"))


@query("""WITH r AS (SELECT o_orderkey AS fid, 'dm_'||(2100+o_custkey%3)||'_line_'||lpad((1+o_custkey%4)::VARCHAR,2,'0')||'_2500' AS table_name, 'dm_'||(2100+o_custkey%3)||'_line' AS source_layer FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY source_layer ORDER BY table_name, fid) AS k, count(*) OVER (PARTITION BY source_layer) AS total FROM r)
SELECT source_layer, '{"total":'||any_value(total)||',"page":2,"pageSize":20,"features":['||coalesce(string_agg('{"table_name":"'||table_name||'","fid":'||fid||'}', ',' ORDER BY k) FILTER (WHERE k BETWEEN 21 AND 40),'')||']}' AS body FROM n GROUP BY source_layer""")
def feature_responses(spark, d):
    c = F.col("o_custkey")
    layer = F.concat(F.lit("dm_"), (c % 3 + 2100).cast("string"), F.lit("_line"))
    rows = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("fid"), F.concat(layer, F.lit("_"), F.lpad((c % 4 + 1).cast("string"), 2, "0"), F.lit("_2500")).alias("table_name"), layer.alias("source_layer"))
    return featurequery.responses(rows, 2, 20)


@query(f"WITH {D.SQL_SURVEY} SELECT count(*)::BIGINT AS scanned, count(*)::BIGINT AS converted, true AS equal FROM element WHERE message IS NOT NULL")
def same_warnings(spark, d):
    """The warnings of a scan and of a conversion of the same files."""
    scan, convert = (features.events(survey.frame(D.survey_files(spark, d))) for _ in range(2))
    return features.same_warnings(scan, convert)
