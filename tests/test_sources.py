"""Round trips, files, catalogue, streams."""

import hashlib
import json
from datetime import datetime, timezone

import numpy as np
import pytest

import gridloom as g
from gridloom.errors import DatasetError, ValidationError
from gridloom.sources import from_labelled, samples
from gridloom.sources.catalogue import items_table, read_items, stac_search

CASES = [
    (np.arange(12, dtype=np.float32).reshape(3, 4), {}),
    (np.arange(24, dtype=np.uint16).reshape(2, 3, 4), {"nodata": 0, "band_names": ["a", None]}),
    (np.array([[np.nan, 1.0]], np.float64), {"nodata": float("nan")}),
    (np.array([[-3]], np.int16), {"crs": None}),
    (np.arange(6, dtype=np.uint8).reshape(2, 3), {"transform": (1.0, 0.2, 5.0, 0.1, -1.0, 9.0)}),
    (np.arange(70 * 300, dtype=np.int32).reshape(70, 300), {"attrs": {"k": "v"}, "timestamp": datetime(2024, 1, 2)}),
]


@pytest.mark.parametrize("array,options", CASES)
@pytest.mark.parametrize("kind", ["parquet", "tif"])
def test_files_round_trip(spark, raster, tmp_path, array, options, kind):
    r = raster(array, **options)
    path = str(tmp_path / f"x.{kind}")
    assert r.save_raster(path) is None
    back = g.load_raster(path, spark=spark)
    np.testing.assert_array_equal(back.to_array(), r.to_array())
    assert back.meta.dtype == r.meta.dtype and back.meta.crs == r.meta.crs and back.band_names == r.band_names
    assert np.allclose(tuple(back.meta.transform), tuple(r.meta.transform))
    if kind == "parquet":
        assert back.timestamp == r.timestamp and back.attrs == r.attrs
    assert g.load_raster(path, band_names=["z"] * r.get_count(), spark=spark).band_names == ["z"] * r.get_count()


def test_stored_tiles_are_pruned(spark, raster, tmp_path):
    path = str(tmp_path / "tiles")
    raster(np.arange(600 * 600, dtype=np.float32).reshape(600, 600)).save_raster(path)
    clip = g.load_raster(path, spark=spark).clip_raster_with_bbox((500010, 4199980, 500040, 4199990))
    plan = clip.df._jdf.queryExecution().executedPlan().toString()
    assert "tile_row" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert clip.to_array().squeeze().tolist() == [601.0, 602.0, 603.0]


def test_missing_file(spark):
    with pytest.raises(FileNotFoundError):
        g.load_raster("/nowhere/x.tif", spark=spark)


def test_lzw_and_packbits():
    from gridloom.sources.geotiff import _lzw, _packbits

    # clear, 7, 7, 8, end in nine-bit codes
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 257))
    assert _lzw(int(bits.ljust(48, "0"), 2).to_bytes(6, "big")) == bytes([7, 7, 7, 8])
    assert _packbits(bytes([2, 1, 2, 3, 254, 9])) == bytes([1, 2, 3, 9, 9, 9])


def test_labelled_round_trip(spark, raster):
    a = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    r = raster(a, timestamp=datetime(2024, 1, 1, 2, tzinfo=timezone.utc))
    t = r.to_labelled()
    back = from_labelled(t, crs="EPSG:32633")
    np.testing.assert_array_equal(back.to_array(), a)
    assert np.allclose(tuple(back.meta.transform), tuple(r.meta.transform)) and back.timestamp == datetime(2024, 1, 1, 2)
    with pytest.raises(ValidationError):
        from_labelled(t.where("x <> 500025.0"))


def test_array_like(spark):
    class Array:
        dims, values = ("time", "y", "x"), np.arange(6, dtype=np.float32).reshape(1, 2, 3)
        coords = {"x": np.array([0.5, 1.5, 2.5]), "y": np.array([9.5, 8.5]), "time": np.array(["2024-01-01"], "datetime64[ns]")}
        attrs = {"crs": "EPSG:4326", "long_name": ("v",), "kept": 1}

    r = g.from_xarray(Array(), spark=spark)
    assert r.meta.bounds == (0.0, 8.0, 3.0, 10.0) and r.band_names == ["v"] and r.attrs == {"kept": 1} and r.timestamp == datetime(2024, 1, 1)
    Array.values, Array.coords = np.zeros((2, 2, 3), np.float32), Array.coords | {"time": np.array(["2024-01-01", "2024-01-02"], "datetime64[ns]")}
    with pytest.raises(ValidationError):
        g.from_xarray(Array(), spark=spark)


def test_read_window(raster):
    a = np.arange(36, dtype=np.float32).reshape(6, 6)
    r = raster(a)
    np.testing.assert_array_equal(r.read(1, window=((1, 3), (2, 5))), a[1:3, 2:5])
    assert r.read(out_shape=(3, 3)).shape == (1, 3, 3)
    np.testing.assert_array_equal(r.get_band(1), a)


ROWS = [
    {"id": "a", "collection": "s2", "bbox": [10.0, 45.0, 11.0, 46.0], "datetime": "2024-06-02T10:00:00Z", "properties": {"eo:cloud_cover": 10.0}},
    {"id": "b", "collection": "s2", "bbox": [20.0, 45.0, 21.0, 46.0], "datetime": "2024-06-01T10:00:00.5Z", "properties": {"eo:cloud_cover": 80.0}},
    {"id": "c", "collection": "s2", "bbox": [10.5, 45.5, 11.5, 46.5], "datetime": None, "start_datetime": "2024-05-01T00:00:00Z", "properties": {}},
    {"id": "d", "collection": "s2", "bbox": [10.5, 45.5, 11.5, 46.5], "datetime": "soon", "properties": {}},
    {"id": "e", "collection": "dem", "bbox": [10.5, 45.5, 11.5, 46.5], "datetime": "2024-06-30T23:59:59Z", "properties": {}},
]


@pytest.fixture
def items(spark):
    box = lambda b: {"type": "Polygon", "coordinates": [[[b[0], b[1]], [b[2], b[1]], [b[2], b[3]], [b[0], b[3]], [b[0], b[1]]]]}
    prop = lambda p: {k: p.get(k) for k in ("platform", "constellation", "instruments", "eo:cloud_cover", "proj:epsg")}
    return items_table([r | {"geometry": box(r["bbox"]), "properties": prop(r["properties"])} for r in ROWS], spark)


def test_search(items):
    ids = lambda **k: [i.id for i in stac_search(k.pop("collection", "s2"), items=items, **k)]
    assert ids() == ["c", "b", "a", "d"]
    assert ids(bbox=(10.9, 45.9, 12, 47)) == ["c", "a", "d"] and ids(bbox=(0, 0, 1, 1)) == []
    assert ids(datetime="2024-06-01/2024-06-02") == ["b", "a"] and ids(datetime="../2024-05-31") == ["c"] and ids(collection="dem", datetime="2024-06-30") == ["e"]
    assert ids(cloud_cover=50) == ["a"] and ids(limit=1) == ["a"] and ids(collection=["dem", "s2"], limit=2) == ["a", "e"]
    assert ids(intersects={"type": "Polygon", "coordinates": [[[10.1, 45.1], [10.2, 45.1], [10.2, 45.2]]]}) == ["a"]
    r = stac_search("s2", items=items)
    assert len(r) == 4 and [i.id for i in r[1:3]] == ["b", "a"] and r[2].cloud_cover == 10.0 and r.timestamps[-1] is None
    for bad in ({"collection": []}, {"bbox": (1, 2, 0, 3)}, {"cloud_cover": 101}, {"limit": 0}, {"bbox": (0, 0, 1, 1), "intersects": {"type": "Polygon", "coordinates": []}}, {"datetime": "2024-02-01/2024-01-01"}):
        with pytest.raises(ValidationError):
            ids(**bad)


def test_recorded_page(spark, tmp_path):
    page = {"features": [{"id": "x", "collection": "c", "bbox": [0, 0, 1, 1], "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}, "properties": {"datetime": "2024-01-01T00:00:00Z", "eo:cloud_cover": 3}, "assets": {"red": {"href": "r.tif"}}}]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    found = stac_search("c", items=read_items(str(tmp_path / "p.json"), spark), cloud_cover=5)
    assert found[0].id == "x" and found[0].asset_names == ["red"]


def test_load_assets(spark, raster, tmp_path):
    a = np.arange(400, dtype=np.uint16).reshape(20, 20) + 1
    fine, coarse = str(tmp_path / "B04.tif"), str(tmp_path / "B11.tif")
    raster(a, nodata=0).save_raster(fine)
    raster(np.arange(100, dtype=np.uint16).reshape(10, 10) + 1, nodata=0, transform=(20.0, 0, 500000.0, 0, -20.0, 4200000.0)).save_raster(coarse)
    items = items_table([{"id": "s", "collection": "c", "bbox": [14.0, 37.0, 16.0, 39.0], "datetime": "2024-06-02T10:00:00Z", "assets": {"B04": fine, "B11": coarse}}], spark)
    item = stac_search("c", items=items)[0]
    r = item.load(["B04", "B11"], spark=spark)
    assert r.band_names == ["B04", "B11"] and r.get_shape() == (20, 20) and r.attrs["stac_item"] == "s"
    np.testing.assert_array_equal(r.to_array()[0], a)
    np.testing.assert_array_equal(r.to_array()[1], (np.arange(100).reshape(10, 10) + 1).repeat(2, 0).repeat(2, 1))
    with pytest.raises(ValidationError):
        item.load(["B99"])
    with pytest.raises(ValidationError):
        item.load("B04", mask=True)


def test_windows_choose_the_blocks_that_are_read(spark, raster, tmp_path):
    from gridloom import load_raster
    from gridloom.sources import geotiff

    a = np.arange(640 * 30, dtype=np.float32).reshape(640, 30)
    path = str(tmp_path / "long.tif")
    raster(a).save_raster(path)  # ten strips of 64 rows
    r = load_raster(path, spark=spark)
    part = r.clip_raster_with_bbox((500000.0, 4200000.0 - 700, 500100.0, 4200000.0 - 650))
    np.testing.assert_array_equal(part.to_array()[0], a[65:70, :10])
    reader = geotiff.GeoTiffReader(path)
    filters = [geotiff.GreaterThanOrEqual(("row",), 65), geotiff.LessThan(("row",), 130), geotiff.EqualTo(("b1",), 3.0)]
    assert list(reader.pushFilters(filters)) == filters and [b.numbers for b in reader.partitions()] == [[1, 2]]
    assert list(reader.pushFilters([geotiff.In(("row",), (70, 80))])) and [b.numbers for b in reader.partitions()] == [[1]]
    # blocks outside the window may be unreadable
    h = geotiff.read_header(path)
    with open(path, "r+b") as f:
        for k in (0, 5, 9):
            f.seek(h.offsets[k])
            f.write(b"\xff" * h.counts[k])
    np.testing.assert_array_equal(load_raster(path, spark=spark).clip_raster_with_bbox((500000.0, 4200000.0 - 700, 500100.0, 4200000.0 - 650)).to_array()[0], a[65:70, :10])


def test_samples(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("GRIDLOOM_DATA_DIR", str(tmp_path / "cache"))
    source = tmp_path / "x.bin"
    source.write_bytes(b"pixels")
    digest = hashlib.sha256(b"pixels").hexdigest()
    files = g.load_sample_dataset({"x.bin": (digest, str(source))}, prefetch=True)
    assert open(files["x.bin"], "rb").read() == b"pixels"
    assert [r.ok for r in samples.verified_files(spark, str(tmp_path / "cache"), {"x.bin": digest}).collect()] == [True]
    (tmp_path / "cache" / "x.bin").write_bytes(b"broken")
    with pytest.raises(DatasetError):
        samples.ensure_asset("x.bin", digest)


def test_stream_equals_batch(spark, tmp_path):
    from gridloom.streaming import pixel_stream, windowed_composite

    rows = [(0, 0, datetime(2024, 1, d, h), float(d * h) if h % 3 else None) for d in range(1, 4) for h in range(0, 24, 2)]
    df = spark.createDataFrame(rows, "row int, col int, ts timestamp, value float")
    df.repartition(3).write.parquet(str(tmp_path / "obs"))
    q = windowed_composite(pixel_stream(spark, str(tmp_path / "obs")), late="10 days").writeStream.outputMode("complete").format("memory").queryName("composite").start()
    try:
        q.processAllAvailable()
        got = sorted(map(tuple, spark.sql("select * from composite").collect()))
    finally:
        q.stop()
    assert got == sorted(map(tuple, windowed_composite(df).collect())) and len(got) == 3


def test_queries_match_sql_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 60
    g.show_versions()
