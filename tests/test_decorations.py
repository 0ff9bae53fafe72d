import pytest

from meshline.operators import decorations

LINE = [(0.0, 0.0), (100.0, 0.0)]
RING = [(0.0, 0.0), (100.0, 0.0), (100.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
D = 1.0606601717798212
SCHEMA = "id long, dmcode long, kind string, zone int, map_level long, dmfigtype long, pts array<struct<x:double,y:double>>"


@pytest.fixture(scope="module")
def pieces(spark):
    cases = [(1101, 2500, None), (1101, 500, None), (2203, 2500, None), (2203, 5000, None), (2205, 2500, None), (2206, 2500, None), (2305, 2500, None), (2306, 2500, None), (4262, 2500, None), (6102, 2500, None), (6110, 2500, 11), (6110, 2500, 12), (6130, 2500, None), (6140, 2500, None), (7106, 2500, None), (7212, 2500, None), (6102, 10000, None), (6102, 2500, 99)]
    rows = [(k, c, "polygon" if c == 4262 else "line", 8, level, fig, RING if c == 4262 else LINE) for k, (c, level, fig) in enumerate(cases)]
    rows.append((100, 6102, "line", 8, 2500, None, [(0.0, 0.0), (0.0, 0.0)]))
    out: dict = {c: [] for c in cases}
    for r in decorations.decorate(spark.createDataFrame(rows, SCHEMA)).orderBy("id", "deco_index").collect():
        assert r["id"] != 100
        out[cases[r["id"]]].append((r["decoration"], r["deco_index"], r["deco_kind"], [(p["x"], p["y"]) for p in r["pts"]]))
    return out


def near(found, *expected):
    assert found == [pytest.approx(p, abs=1e-9) for p in expected]


def test_bridges(pieces):
    both = pieces[2205, 2500, None]
    assert len(both) == 4 and [p[1] for p in both] == [1, 2, 3, 4]
    near(both[0][3], (0, 0), (-D, -D))
    near(both[1][3], (0, 0), (-D, D))
    near(both[2][3], (100, 0), (100 + D, -D))
    a, b = pieces[2203, 2500, None], pieces[2203, 5000, None]
    assert len(a) == 2
    assert abs(a[0][3][1][0]) * 2**0.5 == pytest.approx(1.5) and abs(b[0][3][1][0]) * 2**0.5 == pytest.approx(3.0)


def test_boundary(pieces):
    p = pieces[1101, 2500, None]
    assert len(p) == 30 and p[0][0] == "major_dash" and p[5][0] == "minor_dash"
    near(p[0][3], (0, 0), (12.5, 0))
    near(p[5][3], (15.75, 0), (16.75, 0))
    assert p[7][3][0] == pytest.approx((20, 0))
    assert abs(p[1][3][1][0]) * 2**0.5 == pytest.approx(1.25) and abs(pieces[1101, 500, None][1][3][1][0]) * 2**0.5 == pytest.approx(0.25)


def test_pipe(pieces):
    p = pieces[4262, 2500, None]
    assert len(p) == 8 and all(len(x[3]) == 10 and x[2] == "polygon" for x in p)
    near([p[0][3][0], p[0][3][4], p[0][3][8]], (0, 0), (0.25, -0.25), (0.5, 0))
    assert p[1][3][4] == pytest.approx((46.25, -0.25))


def test_ticks(pieces):
    near(pieces[6140, 2500, None][0][3], (1.25, 0), (1.25, -1.25))
    near(pieces[7106, 2500, None][0][3], (1.25, 0), (1.25, -1.25))
    assert pieces[7106, 2500, None][1][3][0] == pytest.approx((8.75, 0))
    near(pieces[2305, 2500, None][0][3], (1.25, -0.75), (1.25, 0.75))
    assert pieces[2305, 2500, None][1][3][0][0] == pytest.approx(13.75)
    near(pieces[6102, 2500, None][0][3], (1.25, -1.25), (1.25, 1.25))
    assert pieces[6102, 2500, None][1][3][0][0] == pytest.approx(3.75)


def test_arcs(pieces):
    arc, chord, after = pieces[7212, 2500, None][:3]
    near([arc[3][0], arc[3][4], arc[3][8]], (3.75, -1.875), (1.875, 0), (0, -1.875))
    near(chord[3], (1.25, -1.875), (2.5, -1.875))
    assert chord[0] == "center_chord" and after[3][0] == pytest.approx((7.5, -1.875))


def test_dashes_and_dots(pieces):
    p = pieces[6130, 2500, None]
    near(p[0][3], (0, 0), (5, 0))
    near(p[1][3], (8.75, 0), (13.75, 0))
    dots = [x for x in p if x[0] == "gap_circle"]
    assert dots[0][1] == sum(x[0] == "dash_segment" for x in p) + 1 and dots[0][2] == "point"
    near([dots[0][3][0], dots[1][3][0]], (6.875, 0), (15.625, 0))


def test_semicircles_and_triangles(pieces):
    p = pieces[6110, 2500, 11]
    assert len(p) == 20 and p[0][3][4] == pytest.approx((0.5, -0.5)) and p[1][3][0] == pytest.approx((5, 0)) and not pieces[6110, 2500, 12]
    t = pieces[2306, 2500, None]
    near(t[0][3], (1.25, 0), (2.25, -0.75), (3.25, 0), (4.25, 0.75), (5.25, 0))
    assert t[1][3][0] == pytest.approx((26.25, 0))


def test_levels_and_suppression(pieces):
    assert not pieces[6102, 10000, None] and not pieces[6102, 2500, 99]


def test_a_long_line(spark):
    """Ten thousand vertices and as many symbols, in time linear in both."""
    line = [(float(k), float(k % 2)) for k in range(10_001)]
    rows = [(1, 6102, "line", 8, 2500, None, line), (2, 6130, "line", 8, 2500, None, line), (3, 1101, "line", 8, 2500, None, line)]
    found = decorations.decorate(spark.createDataFrame(rows, SCHEMA)).groupBy("id").count().collect()
    counts = {r["id"]: r["count"] for r in found}
    total = 10_000 * 2**0.5
    assert counts[1] == int((total - 2.5) // 2.5) + 1 and counts[2] == int(total // 8.75) + 1 + int((total - 6.875) // 8.75) + 1 and counts[3] > 6 * total / 20 - 7


#: A step of this in x and y is over a centimetre long, but under one in each.
SHORT = 0.0075


def test_short_steps_by_axis_and_by_length(spark):
    """A step of 0.0106 m at 45 degrees goes by the map style's rule and stays where steps count by length."""
    rows = [(1, 6130, "line", 8, 2500, None, [(0.0, 0.0), (4.985, 0.0), (4.985 + SHORT, SHORT)]), (2, 1101, "line", 8, 2500, None, [(0.0, 0.0), (20.0, 0.0), (20.0 + SHORT, SHORT)])]
    last = {}
    for by_axis in (True, False):
        for r in decorations.decorate(spark.createDataFrame(rows, SCHEMA), None, by_axis).where("decoration in ('dash_segment', 'major_dash')").orderBy("deco_index").collect():
            last[by_axis, r["id"]] = (r["deco_index"], r["pts"][-1]["x"], r["pts"][-1]["y"])
    assert last[False, 1] == (1, pytest.approx(4.985 + SHORT), pytest.approx(SHORT)) and last[True, 1] == (1, pytest.approx(4.985), 0.0)
    # The second boundary dash is this step alone.
    assert last[False, 2] == (7, pytest.approx(20 + SHORT), pytest.approx(SHORT)) and last[True, 2][0] == 1


@pytest.mark.parametrize("name", ["deco_dashes", "deco_major_dash"])
def test_short_steps_as_in_sql(spark, tmp_path, name):
    """Orders of sf0.1 whose dashes have such steps at their ends: rows as the SQL has them."""
    import duckdb

    from meshline.plans import queries

    spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").where("l_orderkey in (75162, 113920, 57920, 21920, 47840)").write.parquet(f"{tmp_path}/lineitem.parquet")
    frame = queries.QUERIES[name](spark, str(tmp_path))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(map(tuple, frame.collect())) == sorted(db.sql(f"SELECT {', '.join(frame.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall())
