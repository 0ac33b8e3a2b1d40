"""Blocks, halos, overviews and warps against plain NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import gridloom as g
from gridloom.functions import projection
from gridloom.meta import Affine, RasterMeta
from gridloom.operators import analysis, reproject, resample, stats, tiles, warp


def table_of(spark, a, nan_is_null=True):
    rows = [(r, c, *[None if nan_is_null and np.isnan(b[r, c]) else float(b[r, c]) for b in a]) for r in range(a.shape[1]) for c in range(a.shape[2])]
    return spark.createDataFrame(rows, "row int, col int, " + ", ".join(f"b{i} double" for i in range(1, len(a) + 1)))


def array_of(df, shape, *names):
    out = np.full((len(names), *shape), np.nan)
    for r in df.collect():
        for k, n in enumerate(names):
            assert np.isnan(out[k, r.row, r.col])  # each pixel once
            out[k, r.row, r.col] = np.nan if r[n] is None else r[n]
    return out


def gaps(shape, seed=1, share=0.1):
    r = np.random.default_rng(seed)
    a = r.normal(0, 10, shape)
    a[r.random(shape) < share] = np.nan
    return a


def plain_gradient(v):
    def along(x):
        out = np.full(x.shape, np.nan)
        if len(x) > 1:
            out[1:-1], out[0], out[-1] = (x[2:] - x[:-2]) / 2, x[1] - x[0], x[-1] - x[-2]
        return out

    return along(v), along(v.T).T


def plain_mean(v, radius):
    out = np.full(v.shape, np.nan)
    for r in range(v.shape[0]):
        for c in range(v.shape[1]):
            w = v[max(0, r - radius) : r + radius + 1, max(0, c - radius) : c + radius + 1]
            if np.isfinite(w).any():
                out[r, c] = np.nanmean(w)
    return out


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (4, 4), (8, 8), (13, 18), (17, 5)])
def test_seams_of_small_tiles(spark, shape):
    a = gaps((1, *shape))
    blocks = tiles.tiles_of(table_of(spark, a), *shape, ["double"], side=4)
    assert blocks.count() == -(-shape[0] // 4) * -(-shape[1] // 4)
    np.testing.assert_array_equal(array_of(tiles.pixels_of(blocks, 1), shape, "b1"), a)
    got = array_of(tiles.pixels_of(tiles.surrounding(blocks, *shape, 1, 1, tiles.differences(1.0, 1.0), ["double"] * 3, side=4), 3), shape, "b1", "b2", "b3")
    dy, dx = plain_gradient(a[0])
    np.testing.assert_allclose(got, [a[0], dy, dx])
    got = array_of(tiles.pixels_of(tiles.surrounding(blocks, *shape, 1, 2, tiles.box_means(2), ["double"], side=4), 1), shape, "b1")
    np.testing.assert_allclose(got[0], plain_mean(a[0], 2))


def plain_weighted(a, rows, cols, r_shape):
    down, across = rows.matrix(0, r_shape[0], 0, a.shape[1]), cols.matrix(0, r_shape[1], 0, a.shape[2]).T
    ok = np.isfinite(a)
    w = down @ ok.astype(float) @ across
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(np.abs(w) > 1e-9, down @ np.where(ok, a, 0) @ across / w, np.nan)


@pytest.mark.parametrize("method", ["bilinear", "cubic", "cubic_spline", "lanczos", "gauss", "average"])
def test_weighted_methods_across_seams(spark, method):
    a = gaps((2, 21, 30))
    for h, w, shift in ((50, 17, 0.0), (10, 61, 0.0), (21, 30, 0.3), (25, 40, -3.2)):
        rows, cols = resample.Axis(method, h if shift == 0 else 1.0, 21 if shift == 0 else 1.0, shift, 21, h), resample.Axis(method, w if shift == 0 else 1.0, 30 if shift == 0 else 1.0, shift, 30, w)
        radius = math.ceil(max(rows.reach, cols.reach)) + 1
        blocks = tiles.tiles_of(table_of(spark, a), 21, 30, ["double"] * 2, side=16)
        got = array_of(tiles.pixels_of(tiles.surrounding(blocks, 21, 30, 2, radius, resample.weighing(rows, cols, "float64"), ["double"] * 2, side=16), 2), (h, w), "b1", "b2")
        np.testing.assert_allclose(got, plain_weighted(a, rows, cols, (h, w)), atol=1e-9)


def test_kernels_are_the_same_on_columns_and_arrays(spark):
    x = np.linspace(-3.2, 3.2, 129)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for method in resample.SUPPORT:
        got = [r.w for r in df.orderBy("x").select(resample.kernel(method, F.col("x")).alias("w")).collect()]
        np.testing.assert_allclose(got, resample.weights(method, x), atol=1e-12)


def test_sum_and_rms(raster):
    a = np.arange(36, dtype=np.float32).reshape(6, 6)
    a[0, 0] = -9999
    r = raster(a, nodata=-9999)
    blocks = np.where(a == -9999, np.nan, a).reshape(3, 2, 3, 2).transpose(0, 2, 1, 3).reshape(3, 3, 4)
    np.testing.assert_allclose(r.resample(size=(3, 3), resampling_method="sum").to_array()[0], np.nansum(blocks, 2))
    np.testing.assert_allclose(r.resample(size=(3, 3), resampling_method="rms").to_array()[0], np.sqrt(np.nanmean(blocks**2, 2)), rtol=1e-6)


def test_align_fills_what_is_not_reached(raster):
    a = np.arange(36, dtype=np.float32).reshape(6, 6)
    small = raster(a)
    for method in ("nearest", "bilinear", "average", "max", "mode"):
        wide = raster(np.zeros((9, 11), np.float32), transform=(10.0, 0, 499980.0, 0, -10.0, 4200010.0), nodata=-1)
        out = resample.align_to(small.with_meta(nodata=-1), wide, method)
        assert out.df.count() == 99
        got = out.to_array()[0]
        np.testing.assert_allclose(got[1:7, 2:8], a)
        got[1:7, 2:8] = -1
        assert (got == -1).all()


def shuffled(spark):
    """Shuffle bytes that this session's executors have written."""
    return sum(e.totalShuffleWrite() for e in [spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(i) for i in range(spark.sparkContext._jsc.sc().statusStore().executorList(False).size())])


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A stored raster of 1,100 x 900 pixels, and its array."""
    r, c = np.mgrid[0:1100, 0:900]
    a = (np.sin(r / 37) * 50 + c % 91 + (r * 7 + c * 13) % 17).astype(np.float32)
    a[300:320, 400:700] = -9999
    path = str(tmp_path_factory.mktemp("stored") / "scene")
    g.load_array(a, spark=spark, transform=(10.0, 0, 500000.0, 0, -10.0, 4200000.0), crs="EPSG:32633", nodata=-9999).save_raster(path)
    return g.load_raster(path, spark=spark), np.where(a == -9999, np.nan, a).astype(float)


def test_stored_tiles_send_only_their_borders(spark, stored):
    r, a = stored
    plan = analysis.gradients(r)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    for run in (lambda: analysis.gradients(r).agg(F.sum("dx"), F.sum("dy")), lambda: r.focal_mean(2).df.agg(F.sum("b1")), lambda: r.resample(size=(1000, 1000), resampling_method="cubic").df.agg(F.sum("b1"))):
        before = shuffled(spark)
        run().collect()
        assert 0 < shuffled(spark) - before < 0.1 * 4 * a.size


def test_stored_gradients_and_chains(stored):
    r, a = stored
    t = analysis.gradients(r * 2).toPandas().sort_values(["row", "col"])
    dy, dx = plain_gradient(a * 2)
    np.testing.assert_allclose(t.dy.to_numpy().reshape(a.shape), dy / 10, atol=1e-5)
    np.testing.assert_allclose(t.dx.to_numpy().reshape(a.shape), dx / 10, atol=1e-5)
    assert r.band(1)._tiled and (r * 2)._tiled and not r.clip_raster_with_bbox((500000, 4199900, 500100, 4200000))._tiled


def test_overviews(spark, stored, capsys):
    r, a = stored
    assert r.overviews == 6 == r.band(1).overviews and (r * 2).overviews == 0
    for k in (1, 2, 3, 6):
        level = r.overview(k)
        h, w = -(-1100 // 2**k), -(-900 // 2**k)
        rows, cols = np.minimum(np.arange(h) * 2**k + 2**k // 2, 1099), np.minimum(np.arange(w) * 2**k + 2**k // 2, 899)
        got = level.to_array()[0].astype(float)
        got[got == -9999] = np.nan
        np.testing.assert_array_equal(got, a[np.ix_(rows, cols)])
    files = lambda df: {f.split("/scene/")[1].split("/")[0] + "/" + f.split("/scene/")[1].split("/")[1] for f in df.inputFiles()}
    coarse = resample.decimate(r, 150, 120)
    assert files(coarse.df) <= {f"levels/level={k}" for k in range(1, 7)} and "level=2" in coarse.df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1].split("]")[0].replace(" = ", "=").replace("level#", "level=2 #", 1)
    assert all(f.startswith("tiles/") for f in files(r.df))
    assert coarse.to_array().shape == (1, 150, 120)
    exact, near = (stats.band_statistics(r, approx=x).first() for x in (False, True))
    assert abs(exact["mean"] - near["mean"]) < 1 and near.n_valid + near.n_nodata < exact.n_valid


# -- warps --


def test_control_grids_keep_their_bound():
    source = RasterMeta(4000, 4000, "float32", 1, (10.0, 0, 300000.0, 0, -10.0, 6100000.0), "EPSG:32633")
    for crs in ("EPSG:4326", "EPSG:32634", "EPSG:3035", "EPSG:3413"):
        x0, y0, x1, y1 = projection.convert_bounds(source.crs, crs, source.bounds)
        size = (x1 - x0) / 4000
        t = warp.Transformer(source, math.ceil((y1 - y0) / size), 4000, Affine.from_origin(x0, y1, size, size), crs)
        for r0, c0 in ((0, 0), (1024, 512), (2048, 3072)):
            nodes = t.grid(r0, r0 + 256, c0, c0 + 256)
            col, row = np.meshgrid(np.arange(c0, c0 + 256) + 0.5, np.arange(r0, r0 + 256) + 0.5)
            error = np.hypot(*(t.places(r0, r0 + 256, c0, c0 + 256) - np.stack(t.exact(col, row))))
            assert error.max() < 0.125 and nodes.shape[1] < 40  # within an eighth of a pixel, of few exact places
    exact = warp.Transformer(source, 300, 300, Affine.from_origin(x0, y1, size, size), crs, tolerance=0.0)
    assert exact.grid(0, 64, 0, 64).shape[1:] == (64, 64)


def plain_warp(a, t, method):
    col, row = np.meshgrid(np.arange(t.width) + 0.5, np.arange(t.height) + 0.5)
    u, v = t.exact(col, row)
    out = np.full(u.shape, np.nan)
    for i, j in np.ndindex(u.shape):
        if 0 <= u[i, j] < a.shape[1] and 0 <= v[i, j] < a.shape[0]:
            if method == "nearest":
                out[i, j] = a[int(v[i, j]), int(u[i, j])]
                continue
            n, total, weight = resample.SUPPORT[method], 0.0, 0.0
            for y in range(math.floor(v[i, j] - 0.5) + 1 - n, math.floor(v[i, j] - 0.5) + n + 1):
                for x in range(math.floor(u[i, j] - 0.5) + 1 - n, math.floor(u[i, j] - 0.5) + n + 1):
                    if 0 <= x < a.shape[1] and 0 <= y < a.shape[0] and np.isfinite(a[y, x]):
                        w = float(resample.weights(method, np.array(y + 0.5 - v[i, j])) * resample.weights(method, np.array(x + 0.5 - u[i, j])))
                        total, weight = total + w * a[y, x], weight + w
            out[i, j] = total / weight if abs(weight) > 1e-9 else np.nan
    return out


@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic"])
def test_warp_of_many_tiles(spark, monkeypatch, method):
    a = gaps((1, 60, 70), share=0.03)
    meta = RasterMeta(60, 70, "float64", 1, (1000.0, 0, 300000.0, 0, -1000.0, 6100000.0), "EPSG:32633", float("nan"))
    r = g.Raster.from_table(table_of(spark, a), meta)
    monkeypatch.setattr(warp, "tile_side", lambda t: 16)
    h, w, to = reproject.target_grid(r, "EPSG:3035")
    t = warp.Transformer(meta, h, w, to, "EPSG:3035", 0.0)
    got = array_of(reproject.warp(r, h, w, to, "EPSG:3035", method, 0.0), (h, w), "b1")[0]
    np.testing.assert_allclose(got, plain_warp(a[0], t, method), atol=1e-9)
    rough = array_of(reproject.warp(r, h, w, to, "EPSG:3035", "bilinear"), (h, w), "b1")[0]
    assert np.isfinite(rough).mean() > 0.7


def test_warp_over_the_pole_and_the_antimeridian(spark):
    lat, lon = np.mgrid[89.5:59:-1.0, -179.5:180:1.0]
    a = (lat + np.cos(np.radians(lon)))[None]
    world = g.Raster.from_table(table_of(spark, a), RasterMeta(31, 360, "float64", 1, (1.0, 0, -180.0, 0, -1.0, 90.0), "EPSG:4326", float("nan")))
    to = Affine.from_origin(-2.0e6, 2.0e6, 50000.0, 50000.0)
    got = array_of(reproject.warp(world, 80, 80, to, "EPSG:3413", "nearest"), (80, 80), "b1")[0]
    t = warp.Transformer(world.meta, 80, 80, to, "EPSG:3413", 0.0)
    want = plain_warp(a[0], t, "nearest")
    assert np.isfinite(want).all() and np.isfinite(got).all() and (got == want).mean() > 0.98 and np.abs(got - want).max() < 2.1


def test_rotated_grids_align(raster):
    a = np.arange(100, dtype=np.float32).reshape(10, 10)
    s = math.sqrt(0.5) * 10
    turned = raster(np.zeros((6, 6), np.float32), transform=(s, s, 500031.3, s, -s, 4199957.9), nodata=-1)
    out = resample.align_to(raster(a, nodata=-1), turned, "nearest").to_array()[0]
    for i in range(6):
        for j in range(6):
            x, y = turned.meta.transform.point(j + 0.5, i + 0.5)
            c, r = math.floor((x - 500000) / 10), math.floor((4200000 - y) / 10)
            assert out[i, j] == (a[r, c] if 0 <= r < 10 and 0 <= c < 10 else -1)


def test_assets_of_two_zones(spark, raster, tmp_path):
    from gridloom.sources.catalogue import Item, items_table

    r, c = np.mgrid[0:120, 0:120]
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    raster((r + c).astype(np.float32), nodata=-1, transform=(100.0, 0, 740000.0, 0, -100.0, 5000000.0)).save_raster(first)
    x, y = projection.convert("EPSG:32633", "EPSG:32634", 746000.0, 4994000.0)
    raster((r * 2 + c).astype(np.float32), nodata=-1, crs="EPSG:32634", transform=(100.0, 0, x - 6000, 0, -100.0, y + 6000)).save_raster(second)
    row = items_table([{"id": "s", "assets": {"a": first, "b": second}}], spark).withColumn("ts", F.lit(None).cast("timestamp")).first()
    out = Item(row).load(["a", "b"], spark=spark)
    assert out.get_crs() == "EPSG:32633" and out.band_names == ["a", "b"]
    got = out.to_array()
    assert got[0, 5, 7] == 12
    wrong = seen = 0
    for i in range(10, 110, 7):
        for j in range(10, 110, 7):
            px, py = projection.convert("EPSG:32633", "EPSG:32634", *out.meta.transform.point(j + 0.5, i + 0.5))
            u, v = (px - (x - 6000)) / 100, (y + 6000 - py) / 100
            if 0 <= u < 120 and 0 <= v < 120:
                seen += 1
                wrong += min(u % 1, 1 - u % 1, v % 1, 1 - v % 1) > 0.125 and got[1, i, j] != 2 * math.floor(v) + math.floor(u)
    assert seen > 100 and wrong == 0
