"""Features derived from the star-schema tables, so that operators run on data of any size. Each has the same derivation in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshline.functions import geometry as G
from meshline.operators.decorations import CATALOGUE

LEVELS = (500, 1000, 2500, 5000, 10000)
CODES = tuple(r.code for r in CATALOGUE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple, index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, zone, level, angle of every customer."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), (((k * 7919) % 200001 - 100000) / 10.0).alias("x"), (((k * 104729) % 200001 - 100000) / 10.0).alias("y"), (k % 19 + 1).cast("int").alias("zone"),
        pick(LEVELS, k % 5).cast("long").alias("level"), F.when(k % 4 != 0, ((k * 37) % 720 - 360).cast("double")).alias("angle"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per order with its items as vertices: id, dmcode, kind, zone, map_level, dmfigtype, pts."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    items = F.array_sort(F.collect_list(F.struct(*order)))
    k = F.col("l_orderkey")
    grouped = table(spark, sf_dir, "lineitem").select("l_orderkey", *order).groupBy("l_orderkey").agg(items.alias("v"))
    return grouped.select(
        k.alias("id"), pick(CODES, k % 16).cast("long").alias("dmcode"), F.lit("line").alias("kind"), (k % 19 + 1).cast("int").alias("zone"), pick(LEVELS, k % 5).cast("long").alias("map_level"),
        F.get(F.array(F.lit(None).cast("long"), F.lit(11).cast("long"), F.lit(12).cast("long"), F.lit(99).cast("long")), (F.floor(k / 16) % 4).cast("int")).alias("dmfigtype"),
        F.transform("v", lambda p, i: G.point((i + 1) * 10 + p["l_partkey"] % 10, p["l_quantity"])).alias("pts"),
    )


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle per order: id, x, y, w, h, pts (open ring)."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), (k % 1000).cast("double").alias("x"), (c % 1000).cast("double").alias("y"), (k % 97 + 1).cast("double").alias("w"), (c % 53 + 1).cast("double").alias("h"))
    x, y, w, h = (F.col(v) for v in "xywh")
    ring = F.array(G.point(x, y), G.point(x + w, y), G.point(x + w, y + h), G.point(x, y + h))
    return rows.withColumn("pts", F.when(F.col("id") % 2 == 0, ring).otherwise(F.reverse(ring)))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An element header per order: id, header. Some fields are blank or wrong, some headers cut short."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(
        F.lit("E2"), F.when(k % 11 == 0, F.lit("12X4")).otherwise(F.lpad((k % 9000 + 1000).cast("string"), 4, " ")), F.lpad((k % 100).cast("string"), 2, "0"), F.lpad((c % 10000).cast("string"), 4, " "), F.lpad((k % 10000).cast("string"), 4, "0"),
        F.when(k % 7 == 0, F.lit("  ")).otherwise(F.lpad((k % 100).cast("string"), 2, " ")), (c % 10).cast("string"), F.lpad((k % 50).cast("string"), 2, " "), (k % 3).cast("string"), F.lpad((c % 100).cast("string"), 2, " "), (k % 2).cast("string"),
        F.when(k % 13 == 0, F.lit("    ")).otherwise(F.lpad((k % 40).cast("string"), 4, " ")), F.lpad((k % 8).cast("string"), 4, " "), F.lpad((k % 5000 - 2500).cast("string"), 7, " "), F.lpad(F.format_string("%.2f", (c % 1000) / 4.0), 7, " "), F.lpad((k % 777).cast("string"), 7, " "), F.lpad((k % 10).cast("string"), 2, " "),
        F.lit("       "), F.lpad((k % 1300).cast("string"), 4, "0"), F.lpad((c % 1300).cast("string"), 4, "0"), F.lpad((k % 99).cast("string"), 4, " "),
    )
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 17 == 0, F.substring(text, 1, 40)).otherwise(text).alias("header"))


def survey_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): survey files of 400 order numbers each, every order with items a line element. Some elements have a wrong code, record type or count."""
    k, n = F.col("id"), F.size("pts")
    rows = F.ceil(n / 6).cast("int")
    place = lambda p: F.concat(F.lpad(p["y"].cast("int").cast("string"), 7, " "), F.lpad(p["x"].cast("int").cast("string"), 7, " "))
    code = F.when(k % 11 == 0, "X100").otherwise((F.lit(2100) + k % 3).cast("string"))
    header = F.concat(F.lit("E2"), code, F.lit(" " * 14), F.when(k % 13 == 0, " ").otherwise("2"), F.lit(" " * 6), F.when(k % 17 == 0, " " * 4).otherwise(F.lpad(n.cast("string"), 4, " ")), F.lpad(rows.cast("string"), 4, " "))
    data = F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.array_join(F.transform(F.slice("pts", r * 6 + 1, F.lit(6)), place), ""))
    padded = F.transform(F.concat(F.array(header), data), lambda x: F.rpad(x, 84, " "))
    elements = lines(spark, sf_dir).select(F.floor(k / 400).cast("int").alias("file"), "id", F.array_join(padded, "\r\n").alias("text"))
    f = F.col("file")
    one = lambda *parts: F.rpad(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)), 84, " ")
    number = lambda v, width: F.lpad(v.cast("string"), width, "0")
    sheet = F.array(
        one("M ", number(f % 19 + 1, 2), "DF244", " " * 21, F.lpad(pick(LEVELS, f % 5).cast("string"), 5, " "), " " * 30, F.lpad((f % 3).cast("string"), 2, " ")),
        one(" 100000 200000", " " * 30, "999"), one(" "),
    )
    revisions = F.flatten(F.transform(F.sequence(F.lit(0), (f % 3).cast("int")), lambda r: F.array(one(" " * 9, "0"), one(" " * 40, number(r + 12, 4), number(r + 34, 4)))))
    whole = elements.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("e"))
    text = F.array_join(F.concat(sheet, revisions, F.transform("e", lambda e: e["text"]), F.array(F.lit(""))), "\r\n")
    return whole.select(F.format_string("/in/f%06d.dm", f).alias("path"), F.encode(text, "ISO-8859-1").alias("content"))


#: The same in DuckDB.
SQL_POINTS = """pts AS (SELECT c_custkey AS id, ((c_custkey*7919)%200001-100000)/10.0 AS x, ((c_custkey*104729)%200001-100000)/10.0 AS y, 1+c_custkey%19 AS zone,
 [500,1000,2500,5000,10000][1+c_custkey%5] AS level, CASE WHEN c_custkey%4<>0 THEN ((c_custkey*37)%720-360)::DOUBLE END AS angle FROM customer)"""
SQL_LINES = f"""verts AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice) AS n, l_partkey, l_quantity::DOUBLE AS y FROM lineitem),
 vert AS (SELECT id, n, (10*n+l_partkey%10)::DOUBLE AS x, y FROM verts),
 pair AS (SELECT id, n, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM vert WINDOW w AS (PARTITION BY id ORDER BY n)),
 seg AS (SELECT *, sqrt((x1-x)*(x1-x)+(y1-y)*(y1-y)) AS len FROM pair WHERE x1 IS NOT NULL),
 feat AS (SELECT id, {list(CODES)}[1+id%16] AS dmcode, 1+id%19 AS zone, [500,1000,2500,5000,10000][1+id%5] AS map_level, [NULL,11,12,99][1+(id//16)%4] AS dmfigtype, n AS vertices, min_x, max_x, min_y, max_y
  FROM (SELECT id, count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM vert GROUP BY id)),
 cum AS (SELECT *, sum(len) OVER (PARTITION BY id ORDER BY n) AS e FROM seg WHERE len >= 2.3e-16),
 tot AS (SELECT id, max(e) AS total FROM cum GROUP BY id)"""
SQL_POLYGONS = "poly AS (SELECT o_orderkey AS id, (o_orderkey%1000)::DOUBLE AS x, (o_custkey%1000)::DOUBLE AS y, (1+o_orderkey%97)::DOUBLE AS w, (1+o_custkey%53)::DOUBLE AS h FROM orders)"
SQL_HEADERS = """hdr AS (SELECT id, CASE WHEN id%17=0 THEN t[1:40] ELSE t END AS header FROM (SELECT o_orderkey AS id, 'E2'||CASE WHEN o_orderkey%11=0 THEN '12X4' ELSE lpad((o_orderkey%9000+1000)::VARCHAR,4,' ') END||lpad((o_orderkey%100)::VARCHAR,2,'0')||lpad((o_custkey%10000)::VARCHAR,4,' ')||lpad((o_orderkey%10000)::VARCHAR,4,'0')||
 CASE WHEN o_orderkey%7=0 THEN '  ' ELSE lpad((o_orderkey%100)::VARCHAR,2,' ') END||(o_custkey%10)::VARCHAR||lpad((o_orderkey%50)::VARCHAR,2,' ')||(o_orderkey%3)::VARCHAR||lpad((o_custkey%100)::VARCHAR,2,' ')||(o_orderkey%2)::VARCHAR||
 CASE WHEN o_orderkey%13=0 THEN '    ' ELSE lpad((o_orderkey%40)::VARCHAR,4,' ') END||lpad((o_orderkey%8)::VARCHAR,4,' ')||lpad((o_orderkey%5000-2500)::VARCHAR,7,' ')||lpad(format('{:.2f}',(o_custkey%1000)/4.0),7,' ')||lpad((o_orderkey%777)::VARCHAR,7,' ')||lpad((o_orderkey%10)::VARCHAR,2,' ')||
 '       '||lpad((o_orderkey%1300)::VARCHAR,4,'0')||lpad((o_custkey%1300)::VARCHAR,4,'0')||lpad((o_orderkey%99)::VARCHAR,4,' ') AS t FROM orders))"""


def sql_field(offset: int, width: int, kind: str = "BIGINT", line: str = "header") -> str:
    """A fixed-width field in SQL."""
    pattern = "^[+-]?[0-9]+$" if kind == "BIGINT" else r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    text = f"trim({line}[{offset + 1}:{offset + width}])"
    return f"CASE WHEN length({line}) >= {offset + width} AND regexp_matches({text}, '{pattern}') THEN try_cast({text} AS {kind}) END"


#: The elements of ``survey_files``: element(id, file, line, n, rows, zone, level, ox, oy, message) and, in ``SQL_LINES``, their vertices.
SQL_SURVEY = f"""{SQL_LINES}, own AS (SELECT id, (id//400)::INT AS file, max(n) AS n FROM vert GROUP BY id),
 sheet AS (SELECT file, 1+file%19 AS zone, [500,1000,2500,5000,10000][1+file%5] AS level, 200000+(34+file%3)*u AS ox, 100000+(12+file%3)*u AS oy, 3+2*(1+file%3) AS head, format('f{{:06d}}.dm', file) AS source_file
  FROM (SELECT DISTINCT file, CASE WHEN [500,1000,2500,5000,10000][1+file%5] < 2500 THEN 0.001 ELSE 0.01 END::DOUBLE AS u FROM own)),
 element AS (SELECT own.*, ceil(n/6.0)::INT AS rows, sheet.* EXCLUDE (file), head + coalesce(sum(1+ceil(n/6.0)) OVER (PARTITION BY file ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) + 1 AS line,
  CASE WHEN id%11=0 THEN 'invalid DMCODE' WHEN id%13=0 THEN 'invalid following record type' WHEN id%17=0 THEN 'invalid data count' END AS message FROM own JOIN sheet USING (file))"""
