"""Queries over projections, kernels, overviews and display tables."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import geometry, projection
from ..functions.crs import DATUMS, ELLIPSOIDS
from ..meta import Affine
from ..operators import resample
from . import grids
from .queries import CUST, EVT, MOSAIC, POLYGON, SQL, f32, pixels, query, r6, rounded, shared_path

# -- projections: a place for every customer --

LON, LAT = "(c_custkey * 37 % 4000) / 100.0 - 20", "(c_custkey * 91 % 3500) / 100.0 + 30"
PLACES = f"p AS (SELECT c_custkey AS id, radians({LON}) AS lam, radians({LAT}) AS phi FROM customer)"


def ellipsoid(name: str) -> str:
    axis, inverse = ELLIPSOIDS[name]
    return f"{axis} AS a, {1 / inverse!r} AS f, sqrt({1 / inverse!r} * (2 - {1 / inverse!r})) AS e"


def psi(phi: str) -> str:
    return f"(atanh(sin({phi})) - e * atanh(e * sin({phi})))"


def q(phi: str) -> str:
    return f"((1 - e * e) * (sin({phi}) / (1 - e * e * sin({phi}) * sin({phi})) + atanh(e * sin({phi})) / e))"


def m(phi: str) -> str:
    return f"(cos({phi}) / sqrt(1 - e * e * sin({phi}) * sin({phi})))"


def places_in(spark: SparkSession, d: str, crs: str, source: str = "EPSG:4326", digits: int = 3) -> DataFrame:
    """id, x, y: the customers' places in a CRS."""
    k = F.col("c_custkey")
    df = grids.table(spark, d, "customer").select(k.alias("id"), (k * 37 % 4000 / 100.0 - 20).alias("lon"), (k * 91 % 3500 / 100.0 + 30).alias("lat"))
    df, x, y = projection.convert_columns(df, source, crs, F.col("lon"), F.col("lat"))
    return df.select("id", rounded(x, digits).alias("x"), rounded(y, digits).alias("y"))


@query(
    f"""WITH {PLACES}, g AS (SELECT {ellipsoid('GRS80')}, radians(35) AS s1, radians(65) AS s2, radians(52) AS s0, radians(10) AS l0),
n AS (SELECT *, ln({m('s1')} / {m('s2')}) / ({psi('s2')} - {psi('s1')}) AS n FROM g), c AS (SELECT *, a * {m('s1')} / n * exp(n * {psi('s1')}) AS k FROM n)
SELECT id, {r6(f"4000000 + k * exp(-n * {psi('phi')}) * sin(n * (lam - l0))", 3)} AS x, {r6(f"2800000 + k * exp(-n * {psi('s0')}) - k * exp(-n * {psi('phi')}) * cos(n * (lam - l0))", 3)} AS y FROM p, c"""
)
def project_conformal_cone(spark, d):
    return places_in(spark, d, "EPSG:3034")


@query(
    f"""WITH {PLACES}, g AS (SELECT {ellipsoid('GRS80')}, radians(52) AS s0, radians(10) AS l0), h AS (SELECT *, {q('pi() / 2')} AS qp FROM g),
c AS (SELECT *, a * sqrt(qp / 2) AS r, asin({q('s0')} / qp) AS b0 FROM h), t AS (SELECT *, a * {m('s0')} / (r * cos(b0)) AS dd FROM c),
z AS (SELECT id, lam - l0 AS l, asin({q('phi')} / qp) AS b, b0, r, dd FROM p, t), o AS (SELECT *, r * sqrt(2 / (1 + sin(b0) * sin(b) + cos(b0) * cos(b) * cos(l))) AS k FROM z)
SELECT id, {r6('4321000 + k * dd * cos(b) * sin(l)', 3)} AS x, {r6('3210000 + k / dd * (cos(b0) * sin(b) - sin(b0) * cos(b) * cos(l))', 3)} AS y FROM o"""
)
def project_azimuthal(spark, d):
    return places_in(spark, d, "EPSG:3035")


@query(
    f"""WITH {PLACES}, g AS (SELECT {ellipsoid('GRS80')}, radians(29.5) AS s1, radians(45.5) AS s2, radians(23) AS s0, radians(-96) AS l0),
n AS (SELECT *, ({m('s1')} * {m('s1')} - {m('s2')} * {m('s2')}) / ({q('s2')} - {q('s1')}) AS n FROM g), c AS (SELECT *, {m('s1')} * {m('s1')} + n * {q('s1')} AS c FROM n)
SELECT id, {r6(f"a * sqrt(c - n * {q('phi')}) / n * sin(n * (lam - l0))", 3)} AS x, {r6(f"a * sqrt(c - n * {q('s0')}) / n - a * sqrt(c - n * {q('phi')}) / n * cos(n * (lam - l0))", 3)} AS y FROM p, c"""
)
def project_equal_area_cone(spark, d):
    return places_in(spark, d, "EPSG:5070")


@query(
    f"""WITH {PLACES}, g AS (SELECT {ellipsoid('WGS84')}, radians(70) AS ts, radians(-45) AS l0), c AS (SELECT *, a * {m('ts')} * exp({psi('ts')}) AS k FROM g)
SELECT id, {r6(f"k * exp(-{psi('phi')}) * sin(lam - l0)", 3)} AS x, {r6(f"-k * exp(-{psi('phi')}) * cos(lam - l0)", 3)} AS y FROM p, c"""
)
def project_polar(spark, d):
    return places_in(spark, d, "EPSG:3413")


@query(f"WITH {PLACES} SELECT id, {r6('6371007.181 * lam * cos(phi)', 3)} AS x, {r6('6371007.181 * phi', 3)} AS y FROM p")
def project_sinusoidal(spark, d):
    return places_in(spark, d, "+proj=sinu +R=6371007.181", "+proj=longlat +R=6371007.181")


@query(f"WITH {PLACES}, g AS (SELECT {ellipsoid('WGS84')}) SELECT id, {r6('a * lam', 3)} AS x, {r6(f'a * ' + psi('phi'), 3)} AS y FROM p, g")
def project_mercator(spark, d):
    return places_in(spark, d, "EPSG:3395")


def _rotation(shift: tuple[float, ...]) -> str:
    rx, ry, rz = (f"radians({v} / 3600.0)" for v in shift[3:6])
    t, s = shift[:3], f"(1 + {shift[6]} * 1e-6)"
    return f"{t[0]} + {s} * (x - {rz} * y + {ry} * z) AS x, {t[1]} + {s} * ({rz} * x + y - {rx} * z) AS y, {t[2]} + {s} * (-({ry}) * x + {rx} * y + z) AS z"


@query(
    f"""WITH {PLACES}, g AS (SELECT {ellipsoid('bessel')}), n AS (SELECT id, lam, phi, e, a / sqrt(1 - e * e * sin(phi) * sin(phi)) AS n FROM p, g),
c AS (SELECT id, n * cos(phi) * cos(lam) AS x, n * cos(phi) * sin(lam) AS y, n * (1 - e * e) * sin(phi) AS z FROM n), s AS (SELECT id, {_rotation(DATUMS['potsdam'][1])} FROM c),
w AS (SELECT {ellipsoid('WGS84')}), t AS (SELECT s.*, w.*, a * (1 - f) AS b, atan2(z * a, sqrt(x * x + y * y) * a * (1 - f)) AS t FROM s, w)
SELECT id, {r6('degrees(atan2(y, x))', 9)} AS x, {r6('degrees(atan2(z + e * e / (1 - e * e) * b * pow(sin(t), 3), sqrt(x * x + y * y) - e * e * a * pow(cos(t), 3)))', 9)} AS y FROM t"""
)
def shift_datum(spark, d):
    return places_in(spark, d, "EPSG:4326", "+proj=longlat +datum=potsdam", 9)


# -- a transverse Mercator grid, warped --

_N = 1 / 298.257223563 / (2 - 1 / 298.257223563)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_XI = "xi0 + " + " + ".join(f"{a!r} * sin({2 * j} * xi0) * cosh({2 * j} * eta0)" for j, a in enumerate(_ALPHA, 1))
_ETA = "eta0 + " + " + ".join(f"{a!r} * cos({2 * j} * xi0) * sinh({2 * j} * eta0)" for j, a in enumerate(_ALPHA, 1))
_RADIUS = 0.9996 * 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)


#: Target pixels of 0.0001 degrees from (15.0005, 37.9459) on, and where they lie in the customers' grid of UTM zone 33.
UTM = f"""{CUST}, e AS (SELECT {ellipsoid('WGS84')}), g AS (SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, radians(14.9999 + (c + 0.5) * 0.0001) AS lam, radians(37.9465 - (r + 0.5) * 0.0001) AS phi FROM range(0, 60) a(r), range(0, 70) b(c)),
z AS (SELECT row, col, sinh({psi('phi')}) AS t, lam - radians(15) AS l FROM g, e), y AS (SELECT row, col, atan2(t, cos(l)) AS xi0, atanh(sin(l) / sqrt(t * t + 1)) AS eta0 FROM z),
uv AS (SELECT row, col, (500000 + {_RADIUS!r} * ({_ETA}) - 500000) / 10 AS u, (4200000 - {_RADIUS!r} * ({_XI})) / 10 AS v FROM y)"""


def _warped(spark: SparkSession, d: str, method: str, tolerance: float) -> DataFrame:
    from ..operators.reproject import warp

    r = grids.balances(spark, d)
    df = warp(r, 60, 70, Affine.from_origin(14.9999, 37.9465, 0.0001, 0.0001), "EPSG:4326", method, tolerance)
    return df.select("row", "col", rounded("b1", 2).alias("b1"))


@query(f"WITH {UTM} SELECT uv.row, uv.col, {r6('b1', 2)} AS b1 FROM uv LEFT JOIN cust k ON k.row = floor(v) AND k.col = floor(u)")
def warp_utm_nearest(spark, d):
    return _warped(spark, d, "nearest", 0.0)


@query(
    f"""WITH {UTM}, s AS (SELECT max(row) + 1 AS h FROM cust), i AS (SELECT uv.* FROM uv, s WHERE u >= 0 AND u < 50 AND v >= 0 AND v < h),
t AS (SELECT i.row, i.col, floor(v - 0.5) + a AS r, floor(u - 0.5) + b AS c, (1 - abs(floor(v - 0.5) + a + 0.5 - v)) * (1 - abs(floor(u - 0.5) + b + 0.5 - u)) AS w FROM i, range(2) x(a), range(2) y(b)),
k AS (SELECT t.row, t.col, sum(w * b1) / sum(w) AS b1 FROM t JOIN cust c ON c.row = t.r AND c.col = t.c GROUP BY 1, 2)
SELECT uv.row, uv.col, {r6(f32('b1'), 2)} AS b1 FROM uv LEFT JOIN k USING (row, col)"""
)
def warp_utm_bilinear(spark, d):
    return _warped(spark, d, "bilinear", 0.0)


# -- kernels --

_A = "abs({x})"
KERNELS = {
    "cubic": (2, "CASE WHEN {a} <= 1 THEN (1.5 * {a} - 2.5) * {a} * {a} + 1 WHEN {a} < 2 THEN ((-0.5 * {a} + 2.5) * {a} - 4) * {a} + 2 ELSE 0 END"),
    "cubic_spline": (2, "CASE WHEN {a} <= 1 THEN (0.5 * {a} - 1) * {a} * {a} + 2.0 / 3 WHEN {a} < 2 THEN pow(2 - {a}, 3) / 6 ELSE 0 END"),
    "lanczos": (3, "CASE WHEN {a} < 1e-15 THEN 1 WHEN {a} < 3 THEN 3 * sin(pi() * {a}) * sin(pi() * {a} / 3) / (pi() * pi() * {a} * {a}) ELSE 0 END"),
    "gauss": (2, "CASE WHEN {a} <= 2 THEN exp(-2 * {a} * {a}) ELSE 0 END"),
}


def kernel_sql(method: str) -> str:
    n, weight = KERNELS[method]
    w = lambda at, k: weight.replace("{a}", f"abs(floor({at}) + {k} - {at})")
    return f"""WITH {EVT}, n AS (SELECT max(row) AS top FROM evt), t AS (SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, (r + 0.5) / 2 - 0.5 AS u, (c + 0.5) / 2 - 0.5 AS v FROM n, range(0, 2 * (n.top + 1)) a(r), range(0, 200) b(c)),
p AS (SELECT t.row, t.col, floor(u) + i AS r, floor(v) + j AS c, {w('u', 'i')} AS wr, {w('v', 'j')} AS wc FROM t, range({1 - n}, {n + 1}) x(i), range({1 - n}, {n + 1}) y(j))
SELECT p.row, p.col, {r6(f32('CASE WHEN abs(sum(CASE WHEN e.b1 IS NOT NULL THEN wr * wc END)) > 1e-9 THEN sum(wr * wc * e.b1) / sum(CASE WHEN e.b1 IS NOT NULL THEN wr * wc END) END'), 4)} + CAST(0 AS DOUBLE) AS b1
FROM p JOIN evt e ON e.row = p.r AND e.col = p.c WHERE abs(wr) > 1e-12 AND abs(wc) > 1e-12 GROUP BY 1, 2"""


def _upsampled(spark: SparkSession, d: str, method: str) -> DataFrame:
    return grids.events(spark, d).band(1).resample(scale_factor=2, resampling_method=method).df.select("row", "col", (rounded("b1", 4) + F.lit(0.0)).alias("b1"))


@query(kernel_sql("cubic"))
def resample_cubic(spark, d):
    return _upsampled(spark, d, "cubic")


@query(kernel_sql("cubic_spline"))
def resample_cubic_spline(spark, d):
    return _upsampled(spark, d, "cubic_spline")


@query(kernel_sql("lanczos"))
def resample_lanczos(spark, d):
    return _upsampled(spark, d, "lanczos")


@query(kernel_sql("gauss"))
def resample_gauss(spark, d):
    return _upsampled(spark, d, "gauss")


@query(f"WITH {EVT} SELECT CAST(row // 2 AS INTEGER) AS row, CAST(col // 2 AS INTEGER) AS col, {r6(f32('sum(CAST(b1 AS DOUBLE))'), 3)} AS b1 FROM evt GROUP BY 1, 2")
def resample_sum(spark, d):
    return grids.events(spark, d).band(1).resample(scale_factor=0.5, resampling_method="sum").df.select("row", "col", rounded("b1", 3).alias("b1"))


@query(f"WITH {EVT} SELECT CAST(row // 2 AS INTEGER) AS row, CAST(col // 2 AS INTEGER) AS col, {r6(f32('sqrt(avg(CAST(b1 AS DOUBLE) * b1))'), 3)} AS b1 FROM evt GROUP BY 1, 2")
def resample_rms(spark, d):
    return grids.events(spark, d).band(1).resample(scale_factor=0.5, resampling_method="rms").df.select("row", "col", rounded("b1", 3).alias("b1"))


# -- overviews --


def _stored(spark: SparkSession, d: str):
    path = shared_path(spark)
    grids.events(spark, d).save_raster(path, driver="parquet")
    return sources.load_raster(path, spark=spark)


@query(f"WITH {EVT}, s AS (SELECT max(row) AS top FROM evt), o AS (SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, least(4 * r + 2, top) AS y, 4 * c + 2 AS x FROM s, range(0, CAST(ceil((top + 1) / 4.0) AS BIGINT)) a(r), range(0, 25) b(c)) SELECT o.row, o.col, {r6('b1')} AS b1, {r6('b2')} AS b2, {r6('b3')} AS b3 FROM o JOIN evt e ON e.row = y AND e.col = x")
def overview_level(spark, d):
    """A stored level: the middle one of every four pixels each way."""
    return pixels(_stored(spark, d).overview(2))


@query(f"WITH {EVT} SELECT CAST(row // 4 AS INTEGER) AS row, CAST(col // 4 AS INTEGER) AS col, {r6('b1')} AS b1 FROM evt, (SELECT max(row) + 1 AS h FROM evt) WHERE row % 4 = 2 AND col % 4 = 2 AND row // 4 < h // 4")
def overview_read(spark, d):
    """A decimated read of a stored raster: only a level is read."""
    r = _stored(spark, d).band(1)
    return pixels(resample.decimate(r, r.meta.height // 4, 25).with_meta(height=r.meta.height // 4))


# -- display --

_SHOWN = f"""{EVT}, s AS (SELECT quantile_cont(CAST(b1 AS DOUBLE), 0.02) AS low, quantile_cont(CAST(b1 AS DOUBLE), 0.98) AS high FROM evt),
d AS (SELECT row, col, b1, CASE WHEN b1 IS NOT NULL THEN least(greatest((b1 - low) / (high - low), 0), 1) END AS d1 FROM evt, s)"""


@query(f"WITH {_SHOWN} SELECT row, col, {r6('d1', 5)} AS d1 FROM d")
def plot_band_array(spark, d):
    return grids.events(spark, d).plot_band_array("nir", figsize=(100, 100)).select("row", "col", rounded("d1", 5).alias("d1"))


@query(f"WITH {_SHOWN} SELECT row, col, {r6('d1', 5)} AS d1, CAST(500000.0 + 10 * (col + 0.5) AS DOUBLE) AS x, CAST(4200000.0 - 10 * (row + 0.5) AS DOUBLE) AS y FROM d")
def plot_raster(spark, d):
    return grids.events(spark, d).plot_raster("nir", figsize=(100, 100)).select("row", "col", rounded("d1", 5).alias("d1"), "x", "y")


@query(f"WITH {_SHOWN}, l AS (SELECT min(CAST(b1 AS DOUBLE)) AS lo, max(CAST(b1 AS DOUBLE)) AS hi FROM evt), h AS (SELECT least(15, CAST(floor((b1 - lo) / ((hi - lo) / 16)) AS INTEGER)) AS bin, count(*) AS n FROM evt, l WHERE b1 IS NOT NULL GROUP BY 1) SELECT CAST(k AS INTEGER) AS bin, CAST(coalesce(n, 0) AS BIGINT) AS n, (SELECT count(*) FROM d WHERE d1 IS NOT NULL) AS shown FROM range(16) t(k) LEFT JOIN h ON bin = k")
def plot_raster_with_histogram(spark, d):
    shown, bars = grids.events(spark, d).plot_raster_with_histogram("nir", figsize=(100, 100), bins=16, stretch=True)
    return bars.select("bin", "n").crossJoin(F.broadcast(shown.agg(F.count("d1").alias("shown"))))


# -- saved mosaics, binary geometry --


@query(f"WITH {MOSAIC}, m AS (SELECT row, col, arg_min(b1, prio) FILTER (WHERE b1 IS NOT NULL) AS b1 FROM united GROUP BY 1, 2) SELECT g.row, g.col, {r6('b1', 2)} AS b1 FROM g LEFT JOIN m USING (row, col)")
def mosaic_saved(spark, d):
    """A mosaic written as tiles in the shared folder, and opened again."""
    path = shared_path(spark)
    e, o = grids.events(spark, d).band(1), grids.orders(spark, d, transform=grids.PLACE.shifted(40, 5)).band(1)
    assert e.mosaic(o, save_path=path) is None
    return sources.load_raster(path, spark=spark).df.select("row", "col", rounded("b1", 2).alias("b1"))


@query(SQL["clip_polygon"])
def clip_wkb(spark, d):
    """The same polygons as well-known binary."""
    rings = [ring for polygon in geometry.polygons(POLYGON) for ring in polygon]
    blob = struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r) for r in rings)
    return pixels(grids.events(spark, d).clip_raster_with_vector(blob), 1)
