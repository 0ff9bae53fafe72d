import gzip
import json
import os
import random
import sqlite3

import numpy as np
import pytest
from surveyfile import content, coordinates, element, line, mesh

from meshline.functions.blobs import read_blob, write_blob
from meshline.operators import featurequery, mvt
from meshline.plans import convert
from meshline.sinks import folders, pmtiles
from meshline.sources import geopackage as source
from meshline.sources import manifest
from meshline.streaming import ingest


@pytest.fixture(scope="module")
def survey_folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("in")
    place = ((35, "     10"), (42, "     20"))
    a = [*mesh(), element(2, "6102", "2", 2, 1), *coordinates((0, 0), (0, 100)), element(1, "3001", "2", 4, 1), *coordinates((0, 0), (0, 50), (40, 50), (40, 0)), element(6, "7100", "2", 2, 1), *coordinates((5, 5), (5, 10)), element(7, "8110", "0", 4, 1, *place), line((0, "1"), (1, "0000090"), (20, "TEXT")), element(0)]
    (folder / "a.dm").write_bytes(content(*a))
    (folder / "b.dm").write_bytes(content(*mesh(), element(2, "6102", "2", 2, 1), *coordinates((0, 0), (30, 40))))
    return folder


@pytest.fixture(scope="module")
def gpkg(spark, survey_folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("out") / "out.gpkg")
    summary = convert.convert(spark, convert.Options(str(survey_folder), path))
    return path, summary


def test_geopackage(gpkg):
    path, summary = gpkg
    assert summary["features"] == 5 and summary["skipped"] == 1 and convert.exit_code(None, summary) == 1
    assert sorted(os.listdir(os.path.dirname(path))) == ["out.gpkg"]
    with sqlite3.connect(path) as db:
        assert db.execute("PRAGMA application_id").fetchone()[0] == 1196444487
        rows = db.execute('SELECT fid, USER_ID, DMCODE, DMFILE, geom FROM "dm_6102_line_08_2500" ORDER BY fid').fetchall()
        assert [r[:4] for r in rows] == [(1, 1, 6102, "a.dm"), (2, 2, 6102, "b.dm")]
        assert read_blob(rows[0][4], "line") == (6676, [(200000.0, 100000.0), (200100.0, 100000.0)])
        deco = db.execute('SELECT USER_ID, SRC_LAYER, SRC_USER_ID, DECORATION, DECO_INDEX FROM "dm_6102_line_08_2500_deco_line" ORDER BY fid').fetchall()
        assert [d[0] for d in deco] == list(range(1, len(deco) + 1)) and deco[0][1:] == ("dm_6102_line_08_2500", 1, "perpendicular_tick_1mm", 1)
        assert deco[40][2] == 2 and deco[40][4] == 1
        assert db.execute('SELECT count(*) FROM "rtree_dm_6102_line_08_2500_geom"').fetchone()[0] == 2
        assert db.execute("SELECT organization FROM gpkg_spatial_ref_sys WHERE srs_id=6676").fetchone()[0] == "EPSG"
        assert db.execute('SELECT ANGLE, TEXT FROM "dm_8110_text_08_2500"').fetchone() == (90.0, "TEXT")
        assert db.execute("SELECT count(*) FROM sqlite_master WHERE type='trigger'").fetchone()[0] == 6 * summary["layers"]


def test_geopackage_source(spark, gpkg):
    path, _ = gpkg
    found = {r["table_name"]: r for r in source.catalog(spark, path).collect()}
    assert found["dm_3001_polygon_08_2500"]["layer"]["source_layer"] == "dm_3001_polygon" and found["dm_3001_polygon_08_2500"]["zone"] == 8
    rows = source.features(spark, path, ["dm_6102_line_08_2500"]).orderBy("fid").collect()
    assert [r["USER_ID"] for r in rows] == [1, 2] and rows[0]["TEXT"] is None and rows[0]["geometry"]["srs"] == 6676
    page = featurequery.page(source.features(spark, path).select("table_name", "fid", "layer.source_layer"), "dm_6102_line", 2, 1).collect()
    assert [r["fid"] for r in page] == [2]
    before = sorted(os.listdir(os.path.dirname(path)))
    with pytest.raises(sqlite3.OperationalError), source.connect(path) as db:
        db.execute("CREATE TABLE x (a)")
    assert sorted(os.listdir(os.path.dirname(path))) == before


def test_tiles(spark, gpkg, tmp_path):
    path, _ = gpkg
    out = str(tmp_path / "map")
    summary = convert.convert(spark, convert.Options(path, out, "pmtiles", "survey", zooms=(14, 15)))
    assert sorted(os.listdir(out)) == ["manifest.json", "survey.pmtiles"]
    m = manifest.read(out)
    assert m["levels"] == [2500] and "dm_6102_line" in m["sourceLayers"] and m["center"][2] == 15
    head, meta, tiles = pmtiles.read(f"{out}/survey.pmtiles")
    assert head["addressed"] == summary["tiles"] == len(tiles) and meta["name"] == "survey" and head["type"] == 1
    layers = mvt.read_tile(next(t for i, t in sorted(tiles.items()) if t))
    assert list(layers) == sorted(layers)
    layer = layers["dm_6102_line"]
    tags = layer["features"][0]["tags"]
    values = {layer["keys"][k]: layer["values"][v] for k, v in zip(tags[::2], tags[1::2], strict=True)}
    assert values["DMCODE"] == 6102 and values["ZONE"] == 8 and values["DMFILE"] == "a.dm" and layer["version"] == 2 and layer["extent"] == 4096
    assert layer["features"][0]["type"] == 2 and layer["features"][0]["geometry"][0] == 9
    assert json.loads(open(f"{out}/manifest.json").read())["pmtiles"] == "survey.pmtiles"


def test_validation(spark, survey_folder, tmp_path):
    for o in (convert.Options("/none", str(tmp_path / "a.gpkg")), convert.Options(str(survey_folder), str(tmp_path / "a.txt")), convert.Options(str(survey_folder), str(tmp_path / "m"), "pmtiles", "a b"), convert.Options(str(survey_folder), str(tmp_path / "a.gpkg"), batch=0), convert.Options(str(survey_folder), str(tmp_path / "no" / "a.gpkg"))):
        with pytest.raises(convert.InputError) as e:
            convert.validate(o)
        assert convert.exit_code(e.value, None) == 2
    with pytest.raises(convert.InputError):
        convert.convert(spark, convert.Options(str(survey_folder), str(tmp_path / "a.gpkg"), codes=[9999]))
    assert not os.listdir(tmp_path)


def test_streaming(spark, survey_folder, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for name in ("a.dm", "b.dm"):
        (folder / name).write_bytes((survey_folder / name).read_bytes())
        q = ingest.ingest(spark, str(folder), out, str(tmp_path / "check"))
        assert q.awaitTermination(600) and q.exception() is None
    rows = spark.read.parquet(out).where("dmcode = 6102").orderBy("user_id").collect()
    assert [(r["source_file"], r["user_id"]) for r in rows] == [("a.dm", 1), ("b.dm", 2)]


def test_blobs():
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    assert read_blob(write_blob("polygon", ring, 6676), "polygon") == (6676, ring)
    assert len(write_blob("point", [(1.0, 2.0)], 6676)) == 61
    good = write_blob("line", ring, 1)
    for bad in (b"", b"XX" + good[2:], good[:-1], good[:45] + b"\xff\xff\xff\x7f" + good[49:]):
        with pytest.raises(ValueError):
            read_blob(bad, "line")
    with pytest.raises(ValueError):
        read_blob(good, "polygon")


def test_clipping_and_simplifying():
    assert mvt.simplify([(0, 0), (50, 4), (100, 0)]) == [(0, 0), (100, 0)]
    assert mvt.simplify([(0, 0), (50, 5), (100, 0)]) == [(0, 0), (50, 5), (100, 0)]
    reach, ends = mvt.clip_pieces(*(np.array(v) for v in ((-100, -100), (10, 10), (100, -70), (10, 10))))
    assert reach.tolist() == [True, False] and ends.tolist() == [[-64, 10, 100, 10]]
    assert mvt.clip_ring([(-100, -100), (5000, -100), (5000, 5000), (-100, 5000), (-100, -100)]).__len__() == 4
    drawn = [("polygon", [(0, 0), (0, 10), (10, 10), (10, 0)]), ("polygon", [(0, 0), (5, 5), (10, 10)]), ("point", [(4161, 0)]), ("line", [(0, 0), (0, 100), (9000, 100), (9000, 200), (0, 200)]), ("text", [(3, 4)])]
    flat = np.array([p for _, pts in drawn for p in pts])
    assert mvt.shapes([k for k, _ in drawn], flat[:, 0], flat[:, 1], np.array([len(p) for _, p in drawn])) == [[[(10, 0), (10, 10), (0, 10), (0, 0)]], [], [], [[(0, 0), (0, 100), (4160, 100)], [(4160, 200), (0, 200)]], [[(3, 4)]]]
    assert mvt.commands("line", [[(2, 2), (2, 10)]]) == [9, 4, 4, 10, 0, 16]


def test_archive_ids_and_leaves(tmp_path):
    assert [pmtiles.tile_id(0, 0, 0), pmtiles.tile_id(1, 0, 0), pmtiles.tile_id(1, 0, 1), pmtiles.tile_id(1, 1, 1), pmtiles.tile_id(1, 1, 0)] == [0, 1, 2, 3, 4]
    assert all(pmtiles.tile_of(pmtiles.tile_id(5, x, y)) == (5, x, y) for x in range(32) for y in range(32))
    rng = random.Random(1)
    many = [(k * 9 + rng.randrange(9), rng.randbytes(rng.randrange(1, 200))) for k in range(20_000)]
    pressed = [(i, gzip.compress(b, mtime=0)) for i, b in many]
    pmtiles.assemble(pressed, str(tmp_path / "a.pmtiles"), {}, (0, 9), (0, 0, 1, 1), (0, 0, 1))
    head, _, tiles = pmtiles.read(str(tmp_path / "a.pmtiles"))
    assert head["leaf_bytes"] > 0 and tiles == dict(many)


def test_folders(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for x, text in ((a, "new"), (b, "old")):
        x.mkdir()
        (x / "f").write_text(text)
    folders.replace_folder(str(a), str(b))
    assert (b / "f").read_text() == "new" and sorted(p.name for p in tmp_path.iterdir()) == ["b"]
    calls = []

    def failing(old, new):
        calls.append(new)
        if len(calls) == 4:
            raise OSError("no")
        os.rename(old, new)

    (b / "g").write_text("old")
    with pytest.raises(ExceptionGroup):
        folders.publish(str(b), {"f": b"x", "g": b"y"}, failing)
    assert (b / "f").read_text() == "new" and (b / "g").read_text() == "old" and sorted(p.name for p in b.iterdir()) == ["f", "g"]
    folders.publish(str(b), {"f": b"x"})
    assert (b / "f").read_bytes() == b"x"
    with pytest.raises(ValueError):
        folders.inside(str(b), "../x")
    assert folders.recolor(bytes([0, 0, 0, 255, 255, 255, 255, 255]), (1, 2, 3)) == bytes([1, 2, 3, 255, 1, 2, 3, 0])
    assert folders.append_frame({}, 32, "n", (8, 9))[1] == 41 and folders.pack_atlas([("a", 32, 32)] * 1)[0] == 32


def test_geopackage_writer_in_bounds(spark, tmp_path, monkeypatch):
    """The writer's pages and sorts do not grow with the file, and rows reach it packed: the driver makes no blob and no row of its own."""
    from meshline.sinks import geopackage as sink

    layers = [{"layer": "dm_2100_line_08_2500", "kind": "line", "srs_id": 6676, "decoration": False}, {"layer": "dm_7100_point_08_2500", "kind": "point", "srs_id": 6676, "decoration": False}]
    rows = spark.range(2500).selectExpr(
        "if(id % 3 = 0, 'dm_7100_point_08_2500', 'dm_2100_line_08_2500') layer", "id + 1 ord", "transform(sequence(0, if(id % 3 = 0, 0, id % 4 + 1)), k -> struct(cast(id + k as double) x, cast(id - k as double) y)) pts",
        f"named_struct({', '.join(f'{c!r}, ' + {'USER_ID': 'id + 1', 'DMFILE': repr('a.dm')}.get(c, 'cast(null as long)') for c, _ in (*sink.BASE, ('ANGLE', '')))}) attributes",
    )
    seen = {}
    close = sink.Writer.finish

    def finish(self):
        seen.update(cache=self.db.execute("PRAGMA cache_size").fetchone()[0], temp=self.db.execute("PRAGMA temp_store").fetchone()[0])
        close(self)

    monkeypatch.setattr(sink.Writer, "finish", finish)
    path = str(tmp_path / "out.gpkg")
    staged = f"file://{tmp_path}/staged"
    assert sink.write(rows, layers, path, 100, staged) == {"dm_2100_line_08_2500": 1666, "dm_7100_point_08_2500": 834}
    assert -65536 <= seen["cache"] < 0 and seen["temp"] == 1
    assert spark.read.parquet(staged).agg({"n": "max"}).first()[0] == 100
    assert sink.write(rows, layers, str(tmp_path / "other.gpkg"), 100) == {"dm_2100_line_08_2500": 1666, "dm_7100_point_08_2500": 834}
    with sqlite3.connect(path) as db:
        for layer, kind, ids in (("dm_2100_line_08_2500", "line", [k for k in range(2500) if k % 3]), ("dm_7100_point_08_2500", "point", range(0, 2500, 3))):
            expected = [(n, write_blob(kind, [(float(k + j), float(k - j)) for j in range(k % 4 + 2 if k % 3 else 1)], 6676), k + 1) for n, k in enumerate(ids, 1)]
            assert db.execute(f'SELECT fid, geom, USER_ID FROM "{layer}" ORDER BY fid').fetchall() == expected
            boxes = [(n, float(k), float(k + (k % 4 + 1 if k % 3 else 0)), float(k - (k % 4 + 1 if k % 3 else 0)), float(k)) for n, k in enumerate(ids, 1)]
            assert db.execute(f'SELECT id, minx, maxx, miny, maxy FROM "rtree_{layer}_geom" ORDER BY id').fetchall() == boxes
            assert db.execute("SELECT min_x, max_x, min_y, max_y FROM gpkg_contents WHERE table_name = ?", (layer,)).fetchone() == (min(b[1] for b in boxes), max(b[2] for b in boxes), min(b[3] for b in boxes), max(b[4] for b in boxes))
    found = source.features(spark, path)
    assert found.count() == 2500 and found.where("geometry.error is not null").count() == 0
