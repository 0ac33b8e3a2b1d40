"""GeoTIFF blocks by byte ranges, and files whose blocks are encoded by tasks."""

import struct
import zlib

import numpy as np
import pytest
import zstandard

import gridloom as g
from gridloom.errors import BackendError
from gridloom.operators.clip import window_of
from gridloom.sources import geotiff, ranges


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """A folder that only Spark's file systems reach."""
    folder = tmp_path_factory.mktemp("far")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.far.link./data", f"file://{folder}")
    return "viewfs://far/data"


def scene(raster, n=700, m=600, **options):
    r, c = np.mgrid[0:n, 0:m]
    a = np.stack([(r * 3 + c) % 251, (r ^ c) % 97]).astype(np.uint16)
    a[:, 10:20, 30:300] = 0
    return a, raster(a, nodata=0, band_names=("red", "n<i>r"), **options)


def test_files_anywhere(spark, raster, far):
    a, r = scene(raster)
    path = f"{far}/scene.tif"
    assert r.save_raster(path) is None
    assert not ranges.opens_in_tasks(path) and ranges.exists(spark, path) and not ranges.exists(spark, path + ".part")
    back = g.load_raster(path, spark=spark)
    assert back.band_names == ["red", "n<i>r"] and back.meta.nodata == 0 and back.meta.same_grid(r.meta)
    np.testing.assert_array_equal(back.to_array(), a)
    np.testing.assert_array_equal(window_of(back, 250, 260, 20, 30).to_array(), a[:, 250:270, 260:290])
    np.testing.assert_array_equal((back.band(2) + 1).clip_raster_with_bbox((500000.0, 4199900.0, 500050.0, 4200000.0)).to_array()[0], np.where(a[1, :10, :5] == 0, 0, a[1, :10, :5] + 1))
    with pytest.raises(FileNotFoundError):
        g.load_raster(f"{far}/none.tif", spark=spark)


def test_stored_tiles_anywhere(spark, raster, far):
    a, r = scene(raster, 300, 270)
    r.save_raster(f"{far}/tiles")
    back = g.load_raster(f"{far}/tiles", spark=spark)
    np.testing.assert_array_equal(back.to_array(), a)
    assert back.overview(2).get_shape() == (75, 68)


def test_a_window_takes_few_bytes(spark, raster, far, monkeypatch):
    a, r = scene(raster, 1100, 1100)
    r.save_raster(f"{far}/wide.tif")
    taken = []
    close = ranges.Ranges.close
    monkeypatch.setattr(ranges.Ranges, "close", lambda self: (taken.append(self.taken), close(self)))
    back = g.load_raster(f"{far}/wide.tif", spark=spark)
    part = window_of(back, 600, 600, 50, 50)
    size = sum(geotiff_header(spark, f"{far}/wide.tif").counts)
    assert 0 < taken[1] < size / 10 and taken[0] <= 2 * ranges.HEAD_BYTES  # of 25 blocks a band, one is read
    np.testing.assert_array_equal(part.to_array(), a[:, 600:650, 600:650])
    monkeypatch.setattr(geotiff, "WINDOW_BYTES", 0)  # a window beyond the driver's share
    np.testing.assert_array_equal(window_of(g.load_raster(f"{far}/wide.tif", spark=spark), 600, 600, 50, 50).to_array(), a[:, 600:650, 600:650])


def geotiff_header(spark, path):
    with ranges.open_ranges(path, spark) as source:
        return geotiff.read_header(source)


def test_big_files(spark, raster, tmp_path):
    a, r = scene(raster, 300, 520, transform=(10.0, 1.0, 5.0, 2.0, -10.0, 9.0))
    path = str(tmp_path / "big.tif")
    geotiff.write(spark, path, r.tiles(), r.meta, 256, big=True)
    with open(path, "rb") as f:
        assert f.read(4) == b"II+\0"
    np.testing.assert_array_equal(g.load_raster(path, spark=spark).to_array(), a)
    assert geotiff.read_header(path).meta.transform == r.meta.transform and not list(tmp_path.glob("*.blocks-*"))


@pytest.mark.parametrize("shape", [(1, 1), (64, 256), (300, 17), (257, 513)])
@pytest.mark.parametrize("dtype", ["uint8", "int32", "float32", "float64"])
def test_every_shape(spark, raster, tmp_path, shape, dtype):
    a = (np.arange(shape[0] * shape[1]) % 200).reshape(shape).astype(dtype)
    raster(a).save_raster(str(tmp_path / "x.tif"))
    np.testing.assert_array_equal(g.load_raster(str(tmp_path / "x.tif"), spark=spark).to_array()[0], a)


def hand_made(path, blocks, fields, order="<", counts=None):
    """A classic file of given blocks, big or little end first."""
    tags = sorted([*fields, (273, 4, None), (279, 4, counts or [len(b) for b in blocks])])
    at = 8 + 2 + 12 * len(tags) + 4
    starts = []
    for b in blocks:
        starts.append(at if b else 0)
        at += len(b)
    body, out = b"".join(blocks), struct.pack(order + "H", len(tags))
    for tag, kind, v in tags:
        v = starts if v is None else v
        raw = struct.pack(f"{order}{len(v)}{geotiff._TYPES[kind]}", *v)
        out += struct.pack(order + "HHI", tag, kind, len(v))
        if len(raw) <= 4:
            out += raw.ljust(4, b"\0")
        else:
            out += struct.pack(order + "I", at)
            body += raw
            at += len(raw)
    with open(path, "wb") as f:
        f.write((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + out + b"\0" * 4 + body)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("samples", [1, 2])
def test_floating_point_predictor(tmp_path, order, samples):
    a = np.random.default_rng(0).normal(0, 100, (6, 5, samples)).astype(np.float32)
    lines = np.ascontiguousarray(a.reshape(6, 5 * samples)).astype(">f4").view(np.uint8).reshape(6, 5 * samples, 4).transpose(0, 2, 1).reshape(6, -1)
    delta = lines.copy()
    delta[:, samples:] = lines[:, samples:] - lines[:, :-samples]
    path = str(tmp_path / "p3.tif")
    hand_made(path, [zlib.compress(delta.tobytes())], [(256, 3, [5]), (257, 3, [6]), (258, 3, [32] * samples), (259, 3, [8]), (277, 3, [samples]), (278, 3, [6]), (284, 3, [1]), (317, 3, [3]), (339, 3, [3] * samples)], order)
    h = geotiff.read_header(path)
    with ranges.Ranges(path) as f:
        np.testing.assert_array_equal(geotiff.decode_block(h, f.read(h.offsets[0], h.counts[0])), a)


def test_zstandard_and_blocks_left_out(spark, tmp_path):
    a = np.arange(30, dtype=np.uint16).reshape(6, 5)
    path = str(tmp_path / "z.tif")
    blocks = [zstandard.ZstdCompressor().compress(a[:2].tobytes()), b"", zstandard.ZstdCompressor().compress(a[4:].tobytes())]
    hand_made(path, blocks, [(256, 3, [5]), (257, 3, [6]), (258, 3, [16]), (259, 3, [50000]), (277, 3, [1]), (278, 3, [2]), (339, 3, [1])])
    want = a.copy()
    want[2:4] = 0
    np.testing.assert_array_equal(g.load_raster(path, spark=spark).to_array()[0], want)


def test_what_is_no_tiff(tmp_path):
    (tmp_path / "x.tif").write_bytes(b"nothing of the kind")
    with pytest.raises(BackendError):
        geotiff.read_header(str(tmp_path / "x.tif"))
