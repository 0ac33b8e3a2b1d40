"""Operations against NumPy on small rasters."""

import math
from datetime import datetime

import numpy as np
import pytest

import gridloom as g
from gridloom.errors import AlignmentError, CRSMismatchError, ValidationError
from gridloom.operators import analysis, stats, viz

A = np.array([[1, 2], [3, 4]], np.float32)
B = np.array([[4, 3], [2, 1]], np.float32)


def same(r, expected, **kw):
    np.testing.assert_allclose(r.to_array().squeeze(), expected, rtol=1e-6, equal_nan=True, **kw)


def test_algebra(raster):
    a, b = raster(A), raster(B)
    same(a + b, A + B), same(a - b, A - B), same(a * b, A * B), same(a / b, A / B)
    same(a + 1, A + 1), same(10 - a, 10 - A), same(2 / a, 2 / A), same(a**2, A**2), same(a.sqrt(), np.sqrt(A)), same(a.log(base=2), np.log2(A)), same((a - 3).absolute(), abs(A - 3))


def test_same_base_is_a_projection(raster):
    r = raster(np.stack([A, B]))
    plan = (r.band(1) - r.band(2)).df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    same(r.band(1) - r.band(2), A - B)


def test_division_by_zero(raster):
    d = raster(np.array([[2, 0], [0, 4]], np.float32))
    same(raster(A) / d, [[0.5, 0], [0, 1]])
    same(raster(A) / 0, np.zeros((2, 2)))
    got = raster(A).divide(d, safe=False).to_array()[0]
    assert got[0, 1] == math.inf and got[0, 0] == 0.5


def test_integers_wrap(raster):
    a = np.array([[250, 5], [0, 255]], np.uint8)
    r = raster(a)
    same(r + 10, a + np.uint8(10)), same(r * 3, a * np.uint8(3)), same(r - 6, a - np.uint8(6)), same(r**3, a**3)
    assert (r + 10).meta.dtype == "uint8"
    low = np.array([[-32768, 1], [2, 32767]], np.int16)
    same(raster(low).absolute(), np.abs(low))
    assert (r + 300).meta.dtype == "uint16" and (r + 0.5).meta.dtype == "float32"


def test_nodata_spreads(gappy, raster):
    other = np.arange(36, dtype=np.float32).reshape(6, 6)
    other[4:, 4:] = -1
    out = gappy + raster(other, nodata=-1)
    assert math.isnan(out.meta.nodata)
    expected = np.arange(36, dtype=np.float32).reshape(6, 6) * 2
    expected[:2, :2] = expected[4:, 4:] = np.nan
    same(out, expected)
    ints = np.arange(36, dtype=np.uint16).reshape(6, 6)
    r = raster(ints, nodata=0) + 1
    assert r.meta.nodata == 0 and r.to_array()[0, 0, 0] == 0 and r.to_array()[0, 0, 1] == 2


def test_no_nodata_stays_undeclared(raster):
    r = raster(np.array([[np.nan, 1], [2, 3]], np.float32)) + 1
    assert r.meta.nodata is None and stats.band_statistics(r).first().n_valid == 3


@pytest.mark.parametrize("name,args,f", [
    ("ndvi", {"red": 2}, lambda n, r, b: (n - r) / (n + r)),
    ("ndwi", {"nir": 2}, lambda n, r, b: (n - r) / (n + r)),
    ("ndmi", {"swir": 2}, lambda n, r, b: (n - r) / (n + r)),
    ("ndbi", {"nir": 2}, lambda n, r, b: (n - r) / (n + r)),
    ("evi", {"red": 2, "blue": 3}, lambda n, r, b: 2.5 * (n - r) / (n + 6 * r - 7.5 * b + 1)),
    ("savi", {"red": 2}, lambda n, r, b: 1.5 * (n - r) / (n + r + 0.5)),
])
def test_indices(raster, name, args, f):
    n, r, b = (np.array([[0.8, 0.3], [0.5, 0]], np.float32) * k for k in (1, np.float32(0.5), np.float32(0.25)))
    got = getattr(raster(np.stack([n, r, b])), name)(**args, name="x")
    with np.errstate(all="ignore"):
        expected = np.nan_to_num(f(n, r, b))
    same(got, expected, atol=1e-6)
    assert got.band_names == ["x"] and got.meta.dtype == "float32"


def test_index_arguments(raster):
    r = raster(np.stack([A, B]), band_names=["nir", " Red "])
    same(r.ndvi(red="red", nir="NIR"), (A - B) / (A + B))
    same(r.band(1).ndvi(red=raster(B)), (A - B) / (A + B))
    with pytest.raises(ValidationError):
        r.ndvi(red=1.5)
    with pytest.raises(ValidationError):
        r.ndvi(red="green")
    with pytest.raises(IndexError):
        r.ndvi(red=7)
    with pytest.raises(ValidationError):
        r.normalized_difference(r, name="x")


def test_statistics(gappy):
    assert gappy.get_minimum_pixel(return_position_as_pixel_coordinate=True) == {"minimum": 2.0, "position": (0, 2)}
    assert gappy.get_maximum_pixel() == {"maximum": 35.0, "position": (500050.0, 4199950.0)}
    got = gappy.get_mean_pixel(return_position_as_pixel_coordinate=True)
    assert got["mean"] == 19.25 and got["position"] == (3, 1)
    assert gappy.get_percentile_pixel(50)["percentile"] == np.percentile([v for v in range(36) if v not in (0, 1, 6, 7)], 50)
    assert math.isnan(gappy.extract_value_at_coordinate((500005.0, 4199995.0))) and gappy.extract_value_at_coordinate((500025.0, 4199995.0)) == 2
    with pytest.raises(ValidationError):
        gappy.extract_value_at_coordinate((0.0, 0.0))
    with pytest.raises(ValidationError):
        gappy.get_percentile_pixel(101)
    row = stats.band_statistics(gappy).first()
    assert (row.n_valid, row.n_nodata, row.minimum, row.maximum) == (32, 4, 2.0, 35.0)


def test_all_nodata_has_no_extremum(raster):
    with pytest.raises(ValidationError):
        raster(np.full((2, 2), -1, np.float32), nodata=-1).get_maximum_pixel()


def test_normalisation(gappy):
    a = np.arange(36, dtype=float).reshape(6, 6)
    a[:2, :2] = np.nan
    same(gappy.standardize(), (a - np.nanmean(a)) / np.nanstd(a), atol=1e-6)
    same(gappy.normalize_min_max(new_min=-1, new_max=1), (a - 2) / 33 * 2 - 1, atol=1e-6)
    lo, hi = np.nanpercentile(a, [2, 98])
    same(gappy.normalize_percentile(), np.clip((a - lo) / (hi - lo), 0, 1), atol=1e-6)


def test_constant_raster_normalises_to_nan(raster):
    assert np.isnan(raster(np.full((2, 2), 5, np.float32)).normalize_min_max().to_array()).all()


def test_clip_box(raster):
    a = np.arange(36, dtype=np.float32).reshape(6, 6)
    r = raster(a).clip_raster_with_bbox((500010, 4199960, 500040, 4199990))
    same(r, a[1:4, 1:4])
    assert r.meta.bounds == (500010.0, 4199960.0, 500040.0, 4199990.0)
    same(raster(a).clip_raster_with_bbox((499900, 4199980, 500020, 4300000)), a[:2, :2])
    with pytest.raises(ValidationError):
        raster(a).clip_raster_with_bbox((0, 0, 1, 1))


def test_clip_polygon(raster):
    a = np.arange(36, dtype=np.float32).reshape(6, 6)
    box = {"type": "Polygon", "coordinates": [[[500010, 4199990], [500040, 4199990], [500040, 4199960], [500010, 4199960], [500010, 4199990]], [[500020, 4199980], [500030, 4199980], [500030, 4199970], [500020, 4199970], [500020, 4199980]]]}
    expected = a[1:4, 1:4].copy()
    expected[1, 1] = -1
    same(raster(a, nodata=-1).clip_raster_with_vector(box), expected)
    inverse = raster(a).clip_raster_with_vector(box, crop=False, invert=True, nodata=-5).to_array()[0]
    assert (inverse[1:4, 1:4] == -5).sum() == 8 and inverse[2, 2] == a[2, 2]
    assert raster(a).clip_raster_with_vector(box, crop=False).to_array()[0, 0, 0] == 0
    thin = {"type": "Polygon", "coordinates": [[[500012, 4199988], [500014, 4199988], [500014, 4199962], [500012, 4199962]]]}
    touched = raster(a, nodata=-1).clip_raster_with_vector(thin, crop=False, all_touched=True).to_array()[0]
    assert [tuple(x) for x in np.argwhere(touched != -1)] == [(1, 1), (2, 1), (3, 1)]
    with pytest.raises(ValidationError):
        raster(a).clip_raster_with_vector({"type": "Point", "coordinates": [0, 0]})


def test_resample(raster):
    a = np.arange(36, dtype=np.float32).reshape(6, 6)
    r = raster(a)
    same(r.resample(scale_factor=2), a.repeat(2, 0).repeat(2, 1))
    same(r.resample(size=(2, 3)), a[np.ix_([1, 4], [1, 3, 5])])
    blocks = a.reshape(3, 2, 3, 2)
    same(r.resample(scale_factor=0.5, resampling_method="average"), blocks.mean((1, 3)))
    same(r.resample(scale_factor=0.5, resampling_method="MAX"), blocks.max((1, 3)))
    same(r.resample(scale_factor=0.5, resampling_method="med"), np.median(blocks.transpose(0, 2, 1, 3).reshape(3, 3, 4), axis=2))
    assert r.resample(resolution=(20, 20)).meta.transform.a == 20
    for method in ("bilinear", "cubic", "cubic_spline", "lanczos", "mode", "min", "q1", "q3"):
        got = r.resample(size=(4, 9), resampling_method=method).to_array()
        assert got.shape == (1, 4, 9) and np.isfinite(got).all() and -3 <= got.min() and got.max() <= 38
    flat = raster(np.full((5, 5), 7, np.int16))
    for method in ("bilinear", "cubic", "lanczos", "average"):
        assert (flat.resample(size=(7, 3), resampling_method=method).to_array() == 7).all()
    with pytest.raises(ValidationError):
        r.resample()
    with pytest.raises(ValidationError):
        r.resample(scale_factor=2, resampling_method="best")


def test_resampling_skips_nodata(gappy):
    got = gappy.resample(scale_factor=0.5, resampling_method="average").to_array()[0]
    assert got[0, 0] == -9999 and got[0, 1] == np.mean([2, 3, 8, 9])


def test_alignment(raster):
    a = np.arange(36, dtype=np.float32).reshape(6, 6)
    coarse = np.array([[1, 2, 3], [4, 5, 6], [7, 8, 9]], np.float32)
    c = raster(coarse, transform=(20.0, 0, 500000.0, 0, -20.0, 4200000.0))
    same(raster(a).add(c, method="nearest"), a + coarse.repeat(2, 0).repeat(2, 1))
    with pytest.raises(AlignmentError):
        raster(a).add(c, auto_align=False)
    with pytest.raises(CRSMismatchError):
        raster(a).add(raster(a, crs="EPSG:4326"))


def test_mosaic_and_stack(raster):
    one, two = np.full((3, 3), 1, np.float32), np.full((3, 3), 2, np.float32)
    shift = (10.0, 0.0, 500020.0, 0.0, -10.0, 4200000.0)
    m = raster(one, nodata=-1, band_names=["v"]).mosaic(raster(two, transform=shift, nodata=-1))
    same(m, [[1, 1, 1, 2, 2]] * 3)
    assert m.band_names == ["v"]
    same(raster(one).mosaic(raster(two, transform=shift), method="max"), [[1, 1, 2, 2, 2]] * 3)
    s = raster(one.astype(np.uint16), nodata=0).stack(raster(np.full((3, 3), 9, np.int32), nodata=9), names=["a", "b"])
    assert s.meta.dtype == "int32" and s.band_names == ["a", "b"] and (s.to_array()[1] == 9).all()
    with pytest.raises(ValidationError):
        raster(one).mosaic([])
    with pytest.raises(AlignmentError):
        raster(one).stack(raster(two, transform=shift))


def test_reprojection(raster):
    from gridloom.functions.projection import convert

    for lon, lat in ((12.0, 42.0), (15.5, -33.0), (17.9, 70.0)):
        zone = 32633 if lat > 0 else 32733
        x, y = convert("EPSG:4326", f"EPSG:{zone}", lon, lat)
        assert np.allclose(convert(f"EPSG:{zone}", "EPSG:4326", x, y), (lon, lat), atol=1e-9)
    # a published point: 9 degrees east of the zone's west edge
    assert np.allclose(convert("EPSG:4326", "EPSG:32633", 15.0, 0.0), (500000.0, 0.0), atol=1e-6)
    a = np.arange(400, dtype=np.float32).reshape(20, 20)
    there = raster(a, nodata=-1).reproject_raster(target_crs="EPSG:4326")
    back = there.reproject_raster(target_crs=32633)
    assert there.meta.crs == "EPSG:4326" and back.meta.crs == "EPSG:32633"
    mid = back.get_index()(500105.0, 4199895.0)
    assert abs(back.to_array()[0][mid] - a[10, 10]) <= 21
    with pytest.raises(ValidationError):
        raster(a).reproject_raster(target_crs=1.5)


def test_provenance(raster):
    when = datetime(2024, 5, 1)
    r = raster(np.stack([A, B]), timestamp=when, attrs={"k": "v"}, band_names=["a", "b"])
    assert (r + 1).timestamp == when and (r + 1).attrs == {"k": "v"} and (r + 1).band_names == ["a", "b"]
    assert r.ndvi(red=2).band_names == [None] and r.ndvi(red=2).timestamp == when
    assert g.add(r, 1).timestamp is None and g.add(r, 1).band_names == [None, None]
    assert r.describe() is None


def test_custom_operation(raster):
    @g.raster_op
    def doubled(ds):
        return ds.multiply(2)

    same(raster(A).doubled(), A * 2)


def test_band_names(raster):
    r = raster(np.stack([A, B]), band_names=["x", " "])
    assert r.band_names == ["x", None]
    r.set_band_name(2, "y")
    assert r.band_names == ["x", "y"]
    with pytest.raises(ValidationError):
        r.band_names = ["only one"]
    with pytest.raises(ValidationError):
        r.band(True)


def test_analysis(raster):
    z = raster(np.array([[1, 1], [2, 2]], np.int32))
    rows = {r.zone: r.mean for r in analysis.zonal(raster(A), z).collect()}
    assert rows == {1: 1.5, 2: 3.5}
    assert {(r.from_class, r.to_class): r.n for r in analysis.change_matrix(z, raster(np.array([[1, 2], [2, 2]], np.int32))).collect()} == {(1, 1): 1, (1, 2): 1, (2, 2): 2}
    assert [r.n for r in analysis.threshold_sweep(raster(A), [0, 2, 9]).collect()] == [4, 2, 0]
    a = np.random.default_rng(0).normal(size=(5, 7)).astype(np.float32)
    got = analysis.gradients(raster(a)).orderBy("row", "col").toPandas()
    dy, dx = np.gradient(a.astype(float), 10)
    np.testing.assert_allclose(got.dx.to_numpy().reshape(5, 7), dx, atol=1e-6)
    np.testing.assert_allclose(got.dy.to_numpy().reshape(5, 7), dy, atol=1e-6)
    assert 0 <= raster(a).hillshade().to_array().min() and raster(a).slope().to_array().max() < 90
    assert analysis.time_composite([raster(A), raster(B), raster(A)]).to_array().squeeze().tolist() == A.tolist()


def test_percentiles_equal_numpy(spark):
    from gridloom.functions.quantiles import percentiles

    r = np.random.default_rng(1)
    groups = {1: np.round(r.normal(size=50_000), 2), 2: np.concatenate([np.zeros(41_000), 10.0 ** r.uniform(-3, 9, 4000)]), 3: np.array([5.0]), 4: np.array([1.0, 2.0]), 5: np.array([])}
    at = [0.0, 0.02, 0.5, 0.9, 0.98, 1.0]
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [(5, None), (1, None)]
    got = {x.g: x.p for x in percentiles(spark.createDataFrame(rows, "g int, v double"), at).collect()}
    assert got[5] is None
    for g in (1, 2, 3, 4):
        np.testing.assert_allclose(got[g], np.quantile(groups[g], at), rtol=1e-12)


def test_display(raster):
    r = raster(np.stack([A, B, A]))
    assert [x.n for x in r.plot_histogram(1, bins=3).orderBy("bin").collect()] == [1, 1, 2]
    c = r.plot_composite([1, 2, 3]).collect()
    assert len(c) == 4 and all(x.alpha == 1 for x in c)
    with pytest.raises(ValidationError):
        r.plot_composite([1, 2])
    assert [viz.auto_grid(n) for n in (1, 2, 3, 4, 5, 8, 9)] == [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (2, 4), (3, 3)]
    assert viz.auto_grid(5) == (2, 3) and viz.stretch_limits(raster(np.ones((2, 2), np.float32))).first().low is None
    assert set(r.plot_raster().columns) >= {"x", "y", "d1"}


def test_metadata_runs_no_job(spark, raster):
    r = raster(np.stack([A, B]), band_names=["a", "b"])
    spark.sparkContext.setJobGroup("meta", "meta")
    out = (r + 1).ndvi(red=2).clip_raster_with_bbox((500000, 4199980, 500010, 4200000))
    out.get_shape(), out.get_bounds(), out.get_metadata(), repr(out), out.band_names
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("meta")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
