"""Clips by vector files equal the clip by the same GeoJSON."""

import sqlite3
import struct

import numpy as np
import pytest

from gridloom.errors import BackendError
from gridloom.functions import geometry
from gridloom.functions.projection import convert
from gridloom.sources.vectors import STEP, from_wkb, read_vectors

WKT = 'PROJCS["WGS_1984_UTM_Zone_33N",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",15.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]'
OUTER = [(500012.0, 4199990.0), (500095.0, 4199985.0), (500080.0, 4199915.0), (500015.0, 4199912.0), (500012.0, 4199990.0)]
HOLE = [(500040.0, 4199960.0), (500040.0, 4199940.0), (500062.0, 4199940.0), (500062.0, 4199960.0), (500040.0, 4199960.0)]
FAR = [(500100.0, 4199890.0), (500118.0, 4199890.0), (500118.0, 4199880.0), (500100.0, 4199890.0)]
GEOJSON = {"type": "MultiPolygon", "coordinates": [[OUTER, HOLE], [FAR]]}


def wkb(order="<", srid=False, z=False):
    one = lambda code, kind, body: struct.pack(order + "BI", order == "<", kind | (0x20000000 if srid and code == 6 else 0) | (0x80000000 if z else 0)) + (struct.pack(order + "I", 32633) if srid and code == 6 else b"") + body
    ring = lambda r: struct.pack(order + "I", len(r)) + b"".join(struct.pack(order + ("3d" if z else "2d"), *p, *([1.0] if z else [])) for p in r)
    polygon = lambda rings: one(3, 3, struct.pack(order + "I", len(rings)) + b"".join(map(ring, rings)))
    return one(6, 6, struct.pack(order + "I", 2) + polygon([OUTER, HOLE]) + polygon([FAR]))


def shapefile(path, records):
    body, index, at = b"", b"", 50
    for k, rings in enumerate(records, 1):
        flat = [p for r in rings for p in r]
        starts = np.cumsum([0] + [len(r) for r in rings])[:-1].tolist()
        xs, ys = [p[0] for p in flat], [p[1] for p in flat]
        content = struct.pack("<i4dii", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(flat)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in flat) if rings else struct.pack("<i", 0)
        index += struct.pack(">ii", at, len(content) // 2)
        body += struct.pack(">ii", k, len(content) // 2) + content
        at += (8 + len(content)) // 2
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, n // 2) + struct.pack("<ii8d", 1000, 5, *[0.0] * 8)
    (path.with_suffix(".shp")).write_bytes(head(100 + len(body)) + body)
    (path.with_suffix(".shx")).write_bytes(head(100 + len(index)) + index)


def geopackage(path, blobs, srs):
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER, organization TEXT, organization_coordsys_id INTEGER, definition TEXT)")
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER)")
        db.execute("CREATE TABLE area (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT)")
        db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES ('x', ?, 'EPSG', ?, '')", (srs, srs))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES ('area', 'geom', 'MULTIPOLYGON', ?, 0, 0)", (srs,))
        for b in blobs:
            db.execute("INSERT INTO area (geom) VALUES (?)", (b,))


def header(srs, envelope=0):
    return b"GP\0" + bytes([1 | envelope << 1]) + struct.pack("<i", srs) + b"\0" * {0: 0, 1: 32}[envelope]


@pytest.fixture
def scene(raster):
    return raster(np.arange(144, dtype=np.float32).reshape(12, 12) + 1, nodata=-1)


def test_one_clip_per_format(scene, tmp_path):
    want = scene.clip_raster_with_vector(GEOJSON, crop=False).to_array()
    assert 0 < (want > 0).sum() < 144
    shapefile(tmp_path / "a", [[OUTER, HOLE], [], [FAR]])
    (tmp_path / "a.prj").write_text(WKT)
    geopackage(tmp_path / "a.gpkg", [header(32633, 1) + wkb(), None, header(32633)[:3] + bytes([17]) + header(32633)[4:]], 32633)
    for value in (str(tmp_path / "a.shp"), tmp_path / "a.gpkg", wkb(), wkb(">"), wkb(srid=True, z=True)):
        np.testing.assert_array_equal(scene.clip_raster_with_vector(value, crop=False).to_array(), want)


def test_files_name_their_crs(scene, tmp_path):
    geographic = [[convert("EPSG:32633", "EPSG:4326", *p) for p in ring] for ring in (OUTER, HOLE)]
    shapefile(tmp_path / "g", [geographic])
    (tmp_path / "g.prj").write_text('GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]')
    want = scene.clip_raster_with_vector({"type": "Polygon", "coordinates": [OUTER, HOLE]}, crop=False).to_array()
    np.testing.assert_array_equal(scene.clip_raster_with_vector(str(tmp_path / "g.shp"), crop=False).to_array(), want)


def test_features_as_a_table(spark, tmp_path):
    square = lambda k: [(k, 0.0), (k, 1.0), (k + 1.0, 1.0), (k + 1.0, 0.0), (k, 0.0)]
    shapefile(tmp_path / "many", [[square(float(k))] for k in range(STEP + 5)])
    df = read_vectors(tmp_path / "many.shp", spark)
    assert df.rdd.getNumPartitions() == 2 and df.count() == STEP + 5
    row = df.where(f"id = {STEP + 2}").first()
    assert geometry.bounds(geometry.polygons(row.geometry)) == (STEP + 2, 0, STEP + 3, 1) and row.crs is None
    geopackage(tmp_path / "b.gpkg", [header(4326) + wkb(), None], 4326)
    assert [(r.id, r.crs) for r in read_vectors(tmp_path / "b.gpkg", spark).collect()] == [(0, "EPSG:4326")]
    with pytest.raises(FileNotFoundError):
        read_vectors(tmp_path / "none.shp", spark)


def test_other_geometries_hold_no_polygons():
    point = struct.pack("<BI2d", 1, 1, 5.0, 6.0)
    line = struct.pack("<BII4d", 1, 2, 2, 0.0, 0.0, 1.0, 1.0)
    assert from_wkb(point)[0] == from_wkb(line)[0] == from_wkb(struct.pack("<BII", 1, 7, 2) + point + line)[0] == []
    with pytest.raises(BackendError):
        from_wkb(struct.pack("<BII", 1, 17, 0))
