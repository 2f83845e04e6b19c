"""Round trips of the file formats."""

import json
import random
import sqlite3
import struct

import numpy as np
import pytest

from orthoflux.grid import GridMeta
from orthoflux.sources import las, tiff, vector


def test_las_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b), float(c), int(k), float(p)) for a, b, c, k, p in zip(*rng.random((3, 50)) * 1000, rng.choice([2, 5, 9], 50), rng.random(50), strict=True)]
    df = spark.createDataFrame(rows, las.SCHEMA).coalesce(1)
    uri = las.write_las(df, f"file://{tmp_path}/las").first().uri
    back = sorted(tuple(r) for r in las.read_las(spark, uri).collect())
    assert np.allclose(back, sorted(rows), atol=5.1e-4)
    assert las.read_las(spark, uri, "ground_and_water").count() == sum(r[3] in (2, 9) for r in rows)


def test_epsg_from_records():
    data = bytearray(las.encode(*np.zeros((4, 1))))
    body = b'PROJCS["x",AUTHORITY["EPSG","31982"]]'
    rec = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(body), b"") + body
    data[227:227] = rec
    struct.pack_into("<II", data, 96, 227 + len(rec), 1)
    assert las.epsg(bytes(data)) == 31982


def test_lzw():
    rnd = random.Random(0)
    for data in (b"", b"a", b"abab" * 5000, bytes(rnd.randrange(256) for _ in range(20000)), bytes(rnd.randrange(3) for _ in range(50000))):
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


@pytest.mark.parametrize("lzw", [True, False])
def test_tiff_round_trip(spark, tmp_path, lzw):
    img = np.arange(300 * 270, dtype=float).reshape(300, 270) / 7
    img[5, 6] = np.nan
    grid = GridMeta(0.5, 100.0, -0.5, 900.0, 270, 300, None, 31982)
    df = spark.createDataFrame([(r, c, None if np.isnan(img[r, c]) else float(img[r, c])) for r in range(300) for c in range(270)], "prow long, pcol long, v double")
    uri = tiff.write_geotiff(df, "v", grid, f"file://{tmp_path}/tif", lzw=lzw).first().uri
    back = {(r.prow, r.pcol): r.v for r in tiff.read_geotiff(spark, uri, ("v",)).collect()}
    assert len(back) == img.size and back[5, 6] is None and back[299, 269] == pytest.approx(img[299, 269], rel=1e-6)
    g = tiff.read_meta(spark, uri)
    assert (g.a, g.c, g.e, g.f, g.width, g.height, g.epsg) == (0.5, 100.0, -0.5, 900.0, 270, 300, 31982)


def test_tile_window(spark, tmp_path):
    df = spark.range(10000).selectExpr("id div 100 AS prow", "id % 100 AS pcol", "id AS v")
    tiff.write_tiles(df, f"{tmp_path}/t", 32)
    assert tiff.read_window(spark, f"{tmp_path}/t", 10, 50, 60, 61, 32).count() == 40


def test_vectors(spark, tmp_path):
    pts = [(1.0, 2.0), (3.0, 4.5)]
    df = spark.createDataFrame(pts, "x double, y double").coalesce(1)
    uri = vector.write_shapefile(df, f"file://{tmp_path}/shp").first().uri
    assert sorted((r.x, r.y) for r in vector.read_shapefile(spark, uri).collect()) == pts
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 0.0)]
    poly = spark.createDataFrame([([ring],)], "rings array<array<struct<x:double,y:double>>>").coalesce(1)
    back = vector.read_shapefile(spark, vector.write_shapefile(poly, f"file://{tmp_path}/poly").first().uri).first()
    assert [(p.x, p.y) for p in back.rings[0]] == ring
    vector.write_geojson(poly, f"{tmp_path}/gj")
    line = next((tmp_path / "gj").glob("part-*.txt")).read_text()
    assert json.loads(line)["geometry"]["coordinates"][0][1] == [2.0, 0.0]
    (tmp_path / "p.geojson").write_text(json.dumps({"features": [{"geometry": {"type": "Point", "coordinates": [1, 2, 9]}, "properties": {}}, {"geometry": {"type": "Point", "coordinates": [3, 4]}, "properties": {"z": 7}}]}))
    assert sorted(tuple(r) for r in vector.load_vector(spark, f"{tmp_path}/p.geojson").collect()) == [(1, 2, 9), (3, 4, 7)]
    con = sqlite3.connect(tmp_path / "p.gpkg")
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    con.execute("INSERT INTO gpkg_geometry_columns VALUES ('pts', 'geom')")
    con.execute("CREATE TABLE pts (geom BLOB, z REAL)")
    con.execute("INSERT INTO pts VALUES (?, 5.5)", (b"GP\0\1" + struct.pack("<i", 4326) + struct.pack("<BI2d", 1, 1, 8.0, 9.0),))
    con.commit()
    con.close()
    assert tuple(vector.load_vector(spark, f"{tmp_path}/p.gpkg").first()) == (8.0, 9.0, 5.5)
    with pytest.raises(ValueError):
        vector.load_vector(spark, "x.fgb")
    assert vector.load_arrays(spark, [1], [2], [3]).count() == 1
