"""One query per operation, over whole tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators, sources, streaming
from ..operators import analysis, resample, stats, viz
from ..raster import Raster
from ..sources.catalogue import items_table, stac_search
from . import grids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The grids in SQL.
EVT = """evt AS (SELECT CAST(event_id // 100 AS INTEGER) AS row, CAST(event_id % 100 AS INTEGER) AS col,
  CASE WHEN event_type <> 'error' THEN CAST(value AS FLOAT) END AS b1, CASE WHEN event_type <> 'error' THEN CAST(user_id AS FLOAT) END AS b2,
  CASE WHEN event_type <> 'error' THEN CAST(regexp_extract(props, '(\\d+)', 1) AS FLOAT) END AS b3 FROM events)"""
ORD = """ord AS (SELECT CAST(o_orderkey // 100 AS INTEGER) AS row, CAST(o_orderkey % 100 AS INTEGER) AS col,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice AS FLOAT) END AS b1, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS FLOAT) END AS b2 FROM orders)"""
PART = "part_ AS (SELECT CAST(p_partkey // 20 AS INTEGER) AS row, CAST(p_partkey % 20 AS INTEGER) AS col, CAST(p_size AS BIGINT) AS size, CAST(p_retailprice AS FLOAT) AS price FROM part)"
CUST = "cust AS (SELECT CAST(c_custkey // 50 AS INTEGER) AS row, CAST(c_custkey % 50 AS INTEGER) AS col, CAST(c_acctbal AS FLOAT) AS b1, c_nationkey AS zone FROM customer)"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded as the SQL's round() does: the double times a power of ten, to the nearest whole number. Spark's own rounds the decimal that a double is printed as, so halves differ."""
    c, unit = F.col(c) if isinstance(c, str) else c, F.lit(10.0**digits)
    return F.round(c.cast("double") * unit) / unit


def pixels(r: Raster, *bands: int) -> DataFrame:
    """row, col and bands: doubles rounded to six digits, or longs."""
    whole = not r.meta.dtype.startswith("float")
    names = [f"b{i}" for i in (bands or range(1, r.meta.count + 1))]
    return r.df.select("row", "col", *[(F.col(b).cast("long") if whole else rounded(b)).alias(b) for b in names])


def shared_path(spark: SparkSession, suffix: str = "") -> str:
    """A new path in the folder that driver and executors share; on one machine, without such a folder, in its temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = re.sub("^file:/+", "/", (named or tempfile.gettempdir()).rstrip("/"))
    return f"{folder if '://' in folder else 'file://' + folder}/gridloom-rasters/{uuid.uuid4().hex}{suffix}"


def r6(x: str, digits: int = 6) -> str:
    return f"CAST(round(CAST({x} AS DOUBLE), {digits}) AS DOUBLE)"


def f32(x: str) -> str:
    return f"CAST({x} AS FLOAT)"


def over(cte: str, *columns: str, source: str = "evt") -> str:
    return f"WITH {cte} SELECT row, col, {', '.join(columns)} FROM {source}"


def nd(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {a} + {b} = 0 THEN 0 ELSE {f32(f'({a} - {b}) / ({a} + {b})')} END"


BOTH = f"{EVT}, {ORD}, pair AS (SELECT e.row, e.col, e.b1 AS a, o.b1 AS b, e.b2 AS a2 FROM evt e JOIN ord o USING (row, col))"


def ord_on_evt(spark: SparkSession, d: str) -> tuple[Raster, Raster]:
    """Events, and orders cut to the events' grid."""
    e = grids.events(spark, d)
    return e, operators.clip.window_of(grids.orders(spark, d), 0, 0, e.meta.height, 100)


# -- algebra --


@query(over(EVT, f"{r6('b1 + CAST(2.5 AS FLOAT)')} AS b1"))
def add_scalar(spark, d):
    return pixels(grids.events(spark, d).band(1) + 2.5)


@query(f"WITH {BOTH} SELECT row, col, {r6('a + b', 2)} AS b1 FROM pair")
def add_raster(spark, d):
    e, o = ord_on_evt(spark, d)
    return e.band(1).add(o.band(1)).df.select("row", "col", rounded("b1", 2).alias("b1"))


@query(over(EVT, f"{r6('b1 - b2')} AS b1"))
def subtract_bands(spark, d):
    e = grids.events(spark, d)
    return pixels(e.band("nir") - e.band("red"))


@query(f"WITH {BOTH} SELECT row, col, {r6('a - b', 2)} AS b1 FROM pair")
def subtract_raster(spark, d):
    e, o = ord_on_evt(spark, d)
    return e.band(1).subtract(o.band(1)).df.select("row", "col", rounded("b1", 2).alias("b1"))


@query(over(EVT, f"{r6('b1 * CAST(3 AS FLOAT)')} AS b1"))
def multiply_scalar(spark, d):
    return pixels(grids.events(spark, d).band(1) * 3)


@query(over(EVT, f"{r6('CASE WHEN b1 IS NULL THEN NULL WHEN b2 = 0 THEN 0 ELSE ' + f32('b1 / b2') + ' END')} AS b1"))
def divide_safe(spark, d):
    e = grids.events(spark, d)
    return pixels(e.band(1) / e.band(2))


@query(over(EVT, f"{r6('CASE WHEN b1 IS NOT NULL THEN 0.0 END')} AS b1"))
def divide_safe_zero_scalar(spark, d):
    return pixels(grids.events(spark, d).band(1) / 0)


@query(f"WITH {PART} SELECT row, col, {r6('CASE WHEN size - 25 = 0 THEN NULL ELSE price / CAST(size - 25 AS FLOAT) END')} AS b1, size = 25 AS infinite FROM part_")
def divide_unsafe(spark, d):
    p = grids.grid(grids.table(spark, d, "part"), "p_partkey", 20, [F.col("p_retailprice"), F.col("p_size") - 25], "float32")
    r = p.band(1).divide(p.band(2), safe=False)
    huge = F.abs(F.col("b1")) == float("inf")
    return r.df.select("row", "col", rounded(F.when(~huge, F.col("b1"))).alias("b1"), huge.alias("infinite"))


@query(f"WITH {PART} SELECT row, col, (size * size * size) % 256 AS b1 FROM part_")
def power_int_wrap(spark, d):
    return pixels(grids.part_sizes(spark, d) ** 3)


@query(f"WITH {PART} SELECT row, col, {r6(f32('pow(CAST(price AS DOUBLE), 0.5)'), 4)} AS b1 FROM part_")
def power_frac(spark, d):
    return (grids.part_prices(spark, d) ** 0.5).df.select("row", "col", rounded("b1", 4).alias("b1"))


@query(f"WITH {CUST} SELECT row, col, {r6(f32('sqrt(greatest(CAST(b1 AS DOUBLE), 0))'), 4)} AS b1 FROM cust")
def sqrt_clamped(spark, d):
    return grids.balances(spark, d).sqrt().df.select("row", "col", rounded("b1", 4).alias("b1"))


@query(f"WITH {CUST} SELECT row, col, {r6(f32('ln(greatest(CAST(b1 AS DOUBLE), 1e-10)) / ln(10)'), 4)} AS b1 FROM cust")
def log_base10(spark, d):
    return grids.balances(spark, d).log(base=10).df.select("row", "col", rounded("b1", 4).alias("b1"))


@query(f"WITH {CUST} SELECT row, col, {r6('abs(b1)')} AS b1 FROM cust")
def absolute(spark, d):
    return pixels(grids.balances(spark, d).absolute())


@query(over(EVT, f"{r6('CAST(100 AS FLOAT) - b1')} AS b1"))
def reflected_subtract(spark, d):
    return pixels(100 - grids.events(spark, d).band(1))


@query(over(EVT, f"{r6('CASE WHEN b1 IS NULL THEN NULL WHEN b1 = 0 THEN 0 ELSE CAST(1 AS FLOAT) / b1 END')} AS b1"))
def reflected_divide(spark, d):
    return pixels(1 / grids.events(spark, d).band(1))


@query(f"WITH {PART} SELECT row, col, (size * 7) % 256 AS b1 FROM part_")
def int_wrap_uint8(spark, d):
    return pixels(grids.part_sizes(spark, d) * 7)


@query(f"WITH {PART} SELECT row, col, (size - 30 + 256) % 256 AS b1 FROM part_")
def int_wrap_below_zero(spark, d):
    return pixels(grids.part_sizes(spark, d) - 30)


# -- indices --


@query(f"WITH {BOTH} SELECT row, col, {r6(nd('a', 'b'))} AS b1 FROM pair")
def normalized_difference(spark, d):
    e, o = ord_on_evt(spark, d)
    return pixels(e.band(1).normalized_difference(o.band(1)))


@query(over(EVT, f"{r6(nd('b1', 'b2'))} AS b1"))
def ndvi(spark, d):
    return pixels(grids.events(spark, d).ndvi(red="red", nir="nir"))


@query(over(EVT, f"{r6(nd('b1', 'b3'))} AS b1"))
def ndwi(spark, d):
    return pixels(grids.events(spark, d).ndwi(nir=3, green=1))


@query(over(EVT, f"{r6(nd('b2', 'b3'))} AS b1"))
def ndmi(spark, d):
    return pixels(grids.events(spark, d).ndmi(swir=3, nir=2))


@query(over(EVT, f"{r6(nd('b3', 'b1'))} AS b1"))
def ndbi(spark, d):
    return pixels(grids.events(spark, d).ndbi(nir=1, swir=3))


_EVI_D = f32(f32(f32("b1 + CAST(6 AS FLOAT) * b2") + " - CAST(7.5 AS FLOAT) * b3") + " + CAST(1 AS FLOAT)")


@query(over(EVT, f"{r6('CASE WHEN b1 IS NULL THEN NULL WHEN ' + _EVI_D + ' = 0 THEN 0 ELSE ' + f32('CAST(2.5 AS FLOAT) * (b1 - b2) / ' + _EVI_D) + ' END', 3)} AS b1"))
def evi(spark, d):
    return grids.events(spark, d).evi(red=2, blue=3).df.select("row", "col", rounded("b1", 3).alias("b1"))


@query(over(EVT, f"{r6('CASE WHEN b1 IS NULL THEN NULL ELSE CAST(1.5 AS FLOAT) * (b1 - b2) / (b1 + b2 + CAST(0.5 AS FLOAT)) END')} AS b1"))
def savi(spark, d):
    return pixels(grids.events(spark, d).savi(red=2, nir=1))


@query(over(EVT, f"{r6(nd('b1', 'b2'))} AS b1"))
def savi_without_soil(spark, d):
    return pixels(grids.events(spark, d).savi(red=2, nir=1, soil_factor=0))


# -- statistics --


@query(f"WITH {EVT} SELECT {r6('b1')} AS v, row, col FROM evt WHERE b1 IS NOT NULL ORDER BY b1 DESC, evt.row, evt.col LIMIT 1")
def max_pixel(spark, d):
    return stats.extremum(grids.events(spark, d), 1, True).select(rounded("v").alias("v"), "row", "col")


@query(f"WITH {EVT} SELECT {r6('b1')} AS v, row, col FROM evt WHERE b1 IS NOT NULL ORDER BY b1, evt.row, evt.col LIMIT 1")
def min_pixel(spark, d):
    return stats.extremum(grids.events(spark, d), 1, False).select(rounded("v").alias("v"), "row", "col")


@query(f"WITH {EVT}, m AS (SELECT avg(CAST(b2 AS DOUBLE)) AS value FROM evt) SELECT {r6('value')} AS value, {r6('b2')} AS v, row, col FROM evt, m WHERE b2 IS NOT NULL ORDER BY abs(b2 - value), evt.row, evt.col LIMIT 1")
def mean_pixel(spark, d):
    e = grids.events(spark, d)
    target = stats.band_table(e, 2).agg(F.avg("v").alias("value"))
    return stats.nearest_to(e, 2, target).select(rounded("value").alias("value"), rounded("v").alias("v"), "row", "col")


@query(f"WITH {EVT}, m AS (SELECT quantile_cont(CAST(b3 AS DOUBLE), 0.9) AS value FROM evt) SELECT {r6('value')} AS value, {r6('b3')} AS v, row, col FROM evt, m WHERE b3 IS NOT NULL ORDER BY abs(b3 - value), evt.row, evt.col LIMIT 1")
def percentile_pixel(spark, d):
    e = grids.events(spark, d)
    target = stats.band_table(e, 3).agg(F.percentile("v", 0.9).alias("value"))
    return stats.nearest_to(e, 3, target).select(rounded("value").alias("value"), rounded("v").alias("v"), "row", "col")


@query(f"WITH {EVT}, p AS (SELECT s_suppkey, CAST(s_suppkey * 7 % 120 AS INTEGER) AS col, CAST(s_suppkey % 10 AS INTEGER) AS row FROM supplier) SELECT s_suppkey, p.row, p.col, {r6('b1')} AS b1 FROM p LEFT JOIN evt USING (row, col)")
def sample_points(spark, d):
    points = grids.table(spark, d, "supplier").select("s_suppkey", (500000.0 + 10 * (F.col("s_suppkey") * 7 % 120) + 3).alias("x"), (4200000.0 - 10 * (F.col("s_suppkey") % 10) - 4).alias("y"))
    return stats.sample_points(grids.events(spark, d), points).select("s_suppkey", "row", "col", rounded("b1").alias("b1"))


def _describe(b: int) -> str:
    return f"SELECT {b} AS band, count(b{b}) AS n_valid, count(*) - count(b{b}) AS n_nodata, {r6(f'100.0 * count(b{b}) / count(*)')} AS valid_percent, {r6(f'min(b{b})')} AS minimum, {r6(f'max(b{b})')} AS maximum, {r6(f'avg(CAST(b{b} AS DOUBLE))', 4)} AS mean, {r6(f'stddev_pop(CAST(b{b} AS DOUBLE))', 4)} AS std FROM evt"


@query(f"WITH {EVT} {_describe(1)} UNION ALL {_describe(2)} UNION ALL {_describe(3)}")
def describe_bands(spark, d):
    s = stats.band_statistics(grids.events(spark, d))
    return s.select("band", "n_valid", "n_nodata", rounded("valid_percent").alias("valid_percent"), rounded("minimum").alias("minimum"), rounded("maximum").alias("maximum"), rounded("mean", 4).alias("mean"), rounded("std", 4).alias("std"))


@query(
    f"""WITH {EVT}, l AS (SELECT CAST(min(b2) AS DOUBLE) AS lo, CAST(max(b2) AS DOUBLE) AS hi FROM evt),
c AS (SELECT CAST(least(15, floor((b2 - lo) / ((hi - lo) / 16))) AS INTEGER) AS bin, count(*) AS n FROM evt, l WHERE b2 IS NOT NULL GROUP BY 1)
SELECT CAST(k AS INTEGER) AS bin, {r6('lo + k * (hi - lo) / 16', 4)} AS low, coalesce(n, 0) AS n FROM range(16) t(k) CROSS JOIN l LEFT JOIN c ON c.bin = k"""
)
def histogram(spark, d):
    return grids.events(spark, d).plot_histogram(2, bins=16).select("bin", rounded("low", 4).alias("low"), "n")


@query(f"WITH {EVT} SELECT 1 AS band, {r6('quantile_cont(CAST(b1 AS DOUBLE), 0.02)', 4)} AS low, {r6('quantile_cont(CAST(b1 AS DOUBLE), 0.98)', 4)} AS high FROM evt UNION ALL SELECT 2, {r6('quantile_cont(CAST(b2 AS DOUBLE), 0.02)', 4)}, {r6('quantile_cont(CAST(b2 AS DOUBLE), 0.98)', 4)} FROM evt")
def stretch_limits(spark, d):
    return viz.stretch_limits(grids.events(spark, d), [1, 2]).select("band", rounded("low", 4).alias("low"), rounded("high", 4).alias("high"))


# -- normalisation --

POOL = f"{EVT}, pool AS (SELECT CAST(b1 AS DOUBLE) AS v FROM evt UNION ALL SELECT CAST(b2 AS DOUBLE) FROM evt)"


def _two(spark: SparkSession, d: str) -> Raster:
    e = grids.events(spark, d)
    return e.derived([e.column(1), e.column(2)])


@query(f"WITH {POOL}, s AS (SELECT avg(v) AS m, stddev_pop(v) AS sd FROM pool) SELECT row, col, {r6(f32('(b1 - m) / sd'), 4)} AS b1, {r6(f32('(b2 - m) / sd'), 4)} AS b2 FROM evt, s")
def standardize(spark, d):
    return _two(spark, d).standardize().df.select("row", "col", rounded("b1", 4).alias("b1"), rounded("b2", 4).alias("b2"))


@query(f"WITH {POOL}, s AS (SELECT min(v) AS lo, max(v) AS hi FROM pool) SELECT row, col, {r6(f32('(b1 - lo) / (hi - lo)'), 5)} AS b1, {r6(f32('(b2 - lo) / (hi - lo)'), 5)} AS b2 FROM evt, s")
def normalize_min_max(spark, d):
    return _two(spark, d).normalize_min_max().df.select("row", "col", rounded("b1", 5).alias("b1"), rounded("b2", 5).alias("b2"))


@query(f"WITH {POOL}, s AS (SELECT min(v) AS lo, max(v) AS hi FROM pool) SELECT row, col, {r6(f32('(b1 - lo) / (hi - lo) * 2 - 1'), 5)} AS b1, {r6(f32('(b2 - lo) / (hi - lo) * 2 - 1'), 5)} AS b2 FROM evt, s")
def normalize_min_max_custom(spark, d):
    return _two(spark, d).normalize_min_max(new_min=-1, new_max=1).df.select("row", "col", rounded("b1", 5).alias("b1"), rounded("b2", 5).alias("b2"))


@query(f"WITH {POOL}, s AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM pool) SELECT row, col, {r6(f32('CASE WHEN b1 IS NOT NULL THEN least(greatest((b1 - lo) / (hi - lo), 0), 1) END'), 5)} AS b1, {r6(f32('CASE WHEN b2 IS NOT NULL THEN least(greatest((b2 - lo) / (hi - lo), 0), 1) END'), 5)} AS b2 FROM evt, s")
def normalize_percentile(spark, d):
    return _two(spark, d).normalize_percentile().df.select("row", "col", rounded("b1", 5).alias("b1"), rounded("b2", 5).alias("b2"))


# -- geometry --


@query(f"WITH {EVT} SELECT CAST(row - 2 AS INTEGER) AS row, CAST(col - 10 AS INTEGER) AS col, {r6('b1')} AS b1 FROM evt WHERE row BETWEEN 2 AND 7 AND col BETWEEN 10 AND 39")
def clip_bbox(spark, d):
    return pixels(grids.events(spark, d).clip_raster_with_bbox((500100.0, 4199920.0, 500400.0, 4199980.0)), 1)


@query(f"WITH {EVT}, w AS (SELECT CAST(row - 1 AS INTEGER) AS row, CAST(col - 5 AS INTEGER) AS col, b1, b2 FROM evt WHERE row BETWEEN 1 AND 8 AND col BETWEEN 5 AND 44) SELECT row, col, {r6(nd('b1', 'b2'))} AS b1 FROM w")
def clip_then_ndvi(spark, d):
    return pixels(grids.events(spark, d).clip_raster_with_bbox((500050.0, 4199910.0, 500450.0, 4199990.0)).ndvi(red=2))


POLYGON = {"type": "Polygon", "coordinates": [[[500033.0, 4199987.0], [500617.0, 4199951.0], [500481.0, 4199904.0], [500102.0, 4199922.0], [500033.0, 4199987.0]], [[500200.0, 4199960.0], [500300.0, 4199960.0], [500250.0, 4199930.0], [500200.0, 4199960.0]]]}


def _inside() -> str:
    crossings = []
    for ring in POLYGON["coordinates"]:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            crossings.append(f"CASE WHEN ({y1} <= y) <> ({y2} <= y) AND x < {x1} + (y - {y1}) * ({x2} - {x1}) / ({y2 - y1 or 1.0}) THEN 1 ELSE 0 END")
    return f"({' + '.join(crossings)}) % 2 = 1"


CENTRES = f"{EVT}, centre AS (SELECT *, 500000.0 + 10.0 * (col + 0.5) AS x, 4200000.0 - 10.0 * (row + 0.5) AS y FROM evt)"


@query(f"WITH {CENTRES} SELECT CAST(row - 1 AS INTEGER) AS row, CAST(col - 3 AS INTEGER) AS col, {r6(f'CASE WHEN {_inside()} THEN b1 END')} AS b1 FROM centre WHERE row BETWEEN 1 AND 9 AND col BETWEEN 3 AND 61")
def clip_polygon(spark, d):
    return pixels(grids.events(spark, d).clip_raster_with_vector(POLYGON), 1)


@query(f"WITH {CENTRES} SELECT row, col, {r6(f'CASE WHEN NOT ({_inside()}) THEN b1 END')} AS b1 FROM centre")
def clip_polygon_invert(spark, d):
    return pixels(grids.events(spark, d).clip_raster_with_vector(POLYGON, crop=False, invert=True), 1)


@query(
    f"WITH {EVT} SELECT row, col, {r6('CASE WHEN row BETWEEN 2 AND 4 AND col BETWEEN 3 AND 8 THEN b1 END')} AS b1 FROM evt"
)
def clip_all_touched(spark, d):
    box = [[500035.0, 4199975.0], [500085.0, 4199975.0], [500085.0, 4199955.0], [500035.0, 4199955.0], [500035.0, 4199975.0]]
    return pixels(grids.events(spark, d).clip_raster_with_vector({"type": "Polygon", "coordinates": [box]}, crop=False, all_touched=True), 1)


@query(f"WITH {EVT}, k AS (SELECT unnest([0, 1]) AS d) SELECT CAST(row * 2 + a.d AS INTEGER) AS row, CAST(col * 2 + b.d AS INTEGER) AS col, {r6('b1')} AS b1 FROM evt, k a, k b")
def resample_nearest_up(spark, d):
    return pixels(grids.events(spark, d).resample(scale_factor=2), 1)


@query(f"WITH {EVT} SELECT CAST(row // 2 AS INTEGER) AS row, CAST(col // 2 AS INTEGER) AS col, {r6('b1')} AS b1 FROM evt WHERE row % 2 = 1 AND col % 2 = 1")
def resample_nearest_down(spark, d):
    return pixels(grids.events(spark, d).resample(scale_factor=0.5), 1)


def _half(agg: str, digits: int = 4) -> str:
    return f"WITH {EVT} SELECT CAST(row // 2 AS INTEGER) AS row, CAST(col // 2 AS INTEGER) AS col, {r6(f32(agg), digits)} AS b1 FROM evt GROUP BY 1, 2"


def _halved(spark: SparkSession, d: str, method: str, band: int = 1) -> DataFrame:
    return grids.events(spark, d).band(band).resample(scale_factor=0.5, resampling_method=method).df.select("row", "col", rounded("b1", 4).alias("b1"))


@query(_half("avg(CAST(b2 AS DOUBLE))"))
def resample_average(spark, d):
    return _halved(spark, d, "average", 2)


@query(_half("max(b1)"))
def resample_max(spark, d):
    return _halved(spark, d, "max")


@query(_half("min(b1)"))
def resample_min(spark, d):
    return _halved(spark, d, "min")


@query(_half("quantile_cont(CAST(b1 AS DOUBLE), 0.5)"))
def resample_median(spark, d):
    return _halved(spark, d, "med")


@query(
    f"""WITH {EVT}, c AS (SELECT CAST(row // 5 AS INTEGER) AS row, CAST(col // 5 AS INTEGER) AS col, CAST(b2 AS BIGINT) % 5 AS v, count(*) AS n FROM evt WHERE b2 IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, v) AS k FROM c) SELECT row, col, CAST(v AS BIGINT) AS b1 FROM r WHERE k = 1"""
)
def resample_mode(spark, d):
    ok = F.col("event_type") != "error"
    r = grids.grid(grids.table(spark, d, "events"), "event_id", 100, [F.when(ok, F.col("user_id") % 5)], "int16", -1)
    return pixels(r.resample(scale_factor=0.2, resampling_method="mode")).where("b1 is not null")


@query(
    f"""WITH {EVT}, n AS (SELECT max(row) AS top FROM evt), t AS (SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, (r + 0.5) / 2 - 0.5 AS u, (c + 0.5) / 2 - 0.5 AS v FROM n, range(0, 2 * (n.top + 1)) a(r), range(0, 200) b(c)),
p AS (SELECT t.row, t.col, floor(u) + i AS r, floor(v) + j AS c, (1 - abs(floor(u) + i - u)) * (1 - abs(floor(v) + j - v)) AS w FROM t, range(2) x(i), range(2) y(j))
SELECT p.row, p.col, {r6(f32('sum(w * e.b1) / sum(CASE WHEN e.b1 IS NOT NULL THEN w END)'), 3)} AS b1 FROM p JOIN evt e ON e.row = p.r AND e.col = p.c WHERE w > 1e-12 GROUP BY 1, 2"""
)
def resample_bilinear(spark, d):
    return grids.events(spark, d).band(1).resample(scale_factor=2, resampling_method="bilinear").df.select("row", "col", rounded("b1", 3).alias("b1"))


MOSAIC = f"""{EVT}, {ORD}, united AS (
SELECT row, col, b1, 0 AS prio FROM evt UNION ALL SELECT CAST(row + 5 AS INTEGER), CAST(col + 40 AS INTEGER), b1, 1 FROM ord),
size AS (SELECT greatest(max(CASE WHEN prio = 0 THEN row END), max(CASE WHEN prio = 1 THEN row END)) + 1 AS h FROM united),
g AS (SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM size, range(0, size.h) a(r), range(0, 140) b(c))"""


def _mosaic(spark: SparkSession, d: str, **options) -> DataFrame:
    e, o = grids.events(spark, d).band(1), grids.orders(spark, d, transform=grids.PLACE.shifted(40, 5)).band(1)
    return e.mosaic(o, **options).df.select("row", "col", rounded("b1", 2).alias("b1"))


@query(f"WITH {MOSAIC}, m AS (SELECT row, col, arg_min(b1, prio) FILTER (WHERE b1 IS NOT NULL) AS b1 FROM united GROUP BY 1, 2) SELECT g.row, g.col, {r6('b1', 2)} AS b1 FROM g LEFT JOIN m USING (row, col)")
def mosaic_first(spark, d):
    return _mosaic(spark, d)


@query(f"WITH {MOSAIC}, m AS (SELECT row, col, max(b1) AS b1 FROM united GROUP BY 1, 2) SELECT g.row, g.col, {r6('b1', 2)} AS b1 FROM g LEFT JOIN m USING (row, col)")
def mosaic_max(spark, d):
    return _mosaic(spark, d, method="max")


@query(f"WITH {BOTH} SELECT row, col, {r6('a')} AS b1, {r6('a2')} AS b2, {r6('coalesce(b, NULL)', 2)} AS b3 FROM pair")
def stack(spark, d):
    e, o = ord_on_evt(spark, d)
    two = e.derived([e.column(1), e.column(2)])
    return two.stack(o.band(1)).df.select("row", "col", rounded("b1").alias("b1"), rounded("b2").alias("b2"), rounded("b3", 2).alias("b3"))


@query(f"WITH {EVT}, h AS (SELECT row // 2 AS r, col // 2 AS c, max(b1) AS m FROM evt GROUP BY 1, 2) SELECT e.row, e.col, {r6('e.b1 + h.m')} AS b1 FROM evt e JOIN h ON h.r = e.row // 2 AND h.c = e.col // 2")
def align_then_add(spark, d):
    e = grids.events(spark, d).band(1)
    coarse = e.resample(scale_factor=0.5, resampling_method="max")
    return pixels(e.add(coarse, method="nearest"))


_R = "6378137.0"
REPROJECT = f"""WITH {CUST}, s AS (SELECT max(row) + 1 AS h, 50 AS w FROM cust),
b AS (SELECT h, w, {_R} * radians(12.0) AS x0, {_R} * radians(12.0 + 0.01 * w) AS x1, {_R} * ln(tan(radians(42.0 - 0.01 * h) / 2 + pi() / 4)) AS y0, {_R} * ln(tan(radians(42.0) / 2 + pi() / 4)) AS y1 FROM s),
z AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / sqrt(CAST(h * h + w * w AS DOUBLE)) AS size FROM b),
t AS (SELECT *, ceil((x1 - x0) / size - 1e-6) AS tw, ceil((y1 - y0) / size - 1e-6) AS th FROM z),
g AS (SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, degrees((x0 + (c + 0.5) * size) / {_R}) AS lon, degrees(2 * atan(exp((y1 - (r + 0.5) * size) / {_R})) - pi() / 2) AS lat FROM t, range(0, CAST(t.th AS BIGINT)) a(r), range(0, CAST(t.tw AS BIGINT)) b(c))
SELECT g.row, g.col, {r6('k.b1')} AS b1 FROM g LEFT JOIN cust k ON k.row = CAST(floor((42.0 - g.lat) / 0.01) AS INTEGER) AND k.col = CAST(floor((g.lon - 12.0) / 0.01) AS INTEGER)"""


@query(REPROJECT)
def reproject_3857(spark, d):
    from ..meta import Affine

    geographic = grids.balances(spark, d, transform=Affine.from_origin(12.0, 42.0, 0.01, 0.01), crs="EPSG:4326")
    return pixels(geographic.reproject_raster(target_crs=3857))


@query()
def reproject_utm(spark, d):
    return pixels(grids.balances(spark, d).reproject_raster(target_crs="EPSG:4326", resampling_method="bilinear"))


# -- catalogue --

ITEMS = """items AS (SELECT o_orderkey AS k, o_orderpriority AS collection, CAST(o_custkey % 340 - 170 AS DOUBLE) AS w, CAST(o_orderkey % 160 - 80 AS DOUBLE) AS s,
CASE WHEN o_orderkey % 7 <> 0 OR o_orderkey % 14 = 0 THEN o_orderdate END AS ts, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey % 101 AS DOUBLE) END AS cloud FROM orders)"""


@query(f"WITH {ITEMS} SELECT CAST(k AS VARCHAR) AS id, collection, strftime(ts, '%Y-%m-%d') AS day FROM items WHERE collection IN ('1-URGENT', '5-LOW') AND cloud <= 40 AND ts >= TIMESTAMP '1996-03-01' AND ts < TIMESTAMP '1997-07-01'")
def items_search(spark, d):
    found = stac_search(["1-URGENT", "5-LOW"], items=grids.scene_items(spark, d), datetime="1996-03-01/1997-06-30", cloud_cover=40)
    return found.df.select("id", "collection", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query(f"WITH {ITEMS} SELECT CAST(k AS VARCHAR) AS id, strftime(ts, '%Y-%m-%d') AS day FROM items WHERE collection = '2-HIGH' ORDER BY ts DESC NULLS LAST, CAST(k AS VARCHAR) LIMIT 25")
def items_order_limit(spark, d):
    return stac_search("2-HIGH", items=grids.scene_items(spark, d), limit=25).df.select("id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query(f"WITH {ITEMS} SELECT CAST(k AS VARCHAR) AS id, w, s FROM items WHERE collection = '3-MEDIUM' AND w <= 25.5 AND w + 1 >= 3.25 AND s <= 30.0 AND s + 1 >= -12.5")
def items_bbox(spark, d):
    found = stac_search("3-MEDIUM", items=grids.scene_items(spark, d), bbox=(3.25, -12.5, 25.5, 30.0))
    return found.df.select("id", F.col("bbox")[0].alias("w"), F.col("bbox")[1].alias("s"))


@query(f"WITH {ITEMS} SELECT CAST(k AS VARCHAR) AS id FROM items WHERE collection = '3-MEDIUM' AND w <= 25.5 AND s <= 30.5 AND w + 1 >= 3.5 AND s + 1 >= -12.5 AND greatest(3.5, w) - w + greatest(-12.5, s) - s <= 1")
def items_intersects(spark, d):
    ring = [[3.5, -12.5], [25.5, -12.5], [25.5, 30.5], [3.5, 30.5], [3.5, -12.5]]
    return stac_search("3-MEDIUM", items=grids.scene_items(spark, d), intersects={"type": "Polygon", "coordinates": [ring]}).df.select("id")


# -- analysis --


@query(f"WITH {CUST} SELECT zone, count(*) AS n, count(b1) AS n_valid, {r6('min(b1)')} AS minimum, {r6('max(b1)')} AS maximum, {r6('avg(CAST(b1 AS DOUBLE))', 4)} AS mean, {r6('stddev_pop(CAST(b1 AS DOUBLE))', 4)} AS std FROM cust GROUP BY zone")
def zonal_mean(spark, d):
    z = analysis.zonal(grids.balances(spark, d), grids.nations(spark, d))
    return z.select("zone", "n", "n_valid", rounded("minimum").alias("minimum"), rounded("maximum").alias("maximum"), rounded("mean", 4).alias("mean"), rounded("std", 4).alias("std"))


@query(f"WITH {CUST} SELECT coalesce(n_regionkey, -1) AS parent, coalesce(zone, -1) AS zone, count(b1) AS n_valid, {r6('avg(CAST(b1 AS DOUBLE))', 4)} AS mean FROM cust JOIN nation ON n_nationkey = zone GROUP BY ROLLUP (n_regionkey, zone)")
def zonal_rollup(spark, d):
    parents = grids.table(spark, d, "nation").select(F.col("n_nationkey").alias("zone"), F.col("n_regionkey").alias("parent"))
    return analysis.zonal_rollup(grids.balances(spark, d), grids.nations(spark, d), parents).select(F.coalesce("parent", F.lit(-1)).alias("parent"), F.coalesce("zone", F.lit(-1)).alias("zone"), "n_valid", rounded("mean", 4).alias("mean"))


@query(f"WITH {PART}, t AS (SELECT count(*) AS total FROM part_) SELECT CAST(size AS BIGINT) AS class, count(*) AS n, {r6('count(*) / max(total)')} AS share, {r6('count(*) * 100.0')} AS area FROM part_, t GROUP BY size")
def class_area(spark, d):
    return analysis.class_shares(grids.part_sizes(spark, d)).select(F.col("class").cast("long").alias("class"), "n", rounded("share").alias("share"), rounded("area").alias("area"))


@query(f"WITH {EVT}, c AS (SELECT CASE WHEN b1 > 50 THEN 1 ELSE 0 END AS f, CASE WHEN b2 > 50 THEN 1 ELSE 0 END AS t FROM evt WHERE b1 IS NOT NULL AND b2 IS NOT NULL) SELECT f AS from_class, t AS to_class, count(*) AS n, {r6('count(*) * 100.0')} AS area FROM c GROUP BY 1, 2")
def change_matrix(spark, d):
    e = grids.events(spark, d)
    cls = lambda k: e.derived([F.when(e.column(k).isNotNull(), (e.column(k) > 50).cast("smallint"))], dtype="int16", nodata=None)
    m = analysis.change_matrix(cls(1), cls(2))
    return m.select(F.col("from_class").cast("int").alias("from_class"), F.col("to_class").cast("int").alias("to_class"), "n", rounded("area").alias("area"))


@query(f"WITH {EVT} SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (WHERE b1 > t) AS n, {r6('count(*) FILTER (WHERE b1 > t) / count(b1)')} AS share FROM evt, (SELECT unnest([10, 25, 50, 100]) AS t) GROUP BY t")
def threshold_sweep(spark, d):
    return analysis.threshold_sweep(grids.events(spark, d), [10, 25, 50, 100]).select("threshold", "n", rounded("share").alias("share"))


@query(f"WITH {EVT}, b AS (SELECT CASE WHEN b1 >= 0 AND b1 < 20 THEN 0 WHEN b1 >= 20 AND b1 < 60 THEN 1 WHEN b1 >= 60 AND b1 < 200 THEN 2 END AS bin, b2 FROM evt WHERE b1 IS NOT NULL) SELECT bin, count(*) AS n, {r6('avg(CAST(b2 AS DOUBLE))', 4)} AS mean FROM b WHERE bin IS NOT NULL GROUP BY bin HAVING count(*) > 50")
def elevation_bins(spark, d):
    e = grids.events(spark, d)
    return analysis.binned(e, e, [0, 20, 60, 200], 1, 2, least=50).select("bin", "n", rounded("mean", 4).alias("mean"))


@query(f"WITH {EVT} SELECT count(*) AS n, {r6('corr(CAST(b1 AS DOUBLE), CAST(b2 AS DOUBLE))')} AS r FROM evt WHERE b1 IS NOT NULL AND b2 IS NOT NULL")
def correlation(spark, d):
    e = grids.events(spark, d)
    return analysis.correlation(e, e, 1, 2).select("n", rounded("r").alias("r"))


GRADIENT = f"""{CUST}, n AS (SELECT max(row) AS h, max(col) AS w FROM cust),
g AS (SELECT row, col, CAST(b1 AS DOUBLE) AS v, lag(CAST(b1 AS DOUBLE)) OVER x AS xb, lead(CAST(b1 AS DOUBLE)) OVER x AS xa, lag(CAST(b1 AS DOUBLE)) OVER y AS yb, lead(CAST(b1 AS DOUBLE)) OVER y AS ya FROM cust
WINDOW x AS (PARTITION BY row ORDER BY col), y AS (PARTITION BY col ORDER BY row)),
gr AS (SELECT row, col, CASE WHEN col = 0 THEN xa - v WHEN col = w THEN v - xb ELSE (xa - xb) / 2 END / 10 AS dx, CASE WHEN row = 0 THEN ya - v WHEN row = h THEN v - yb ELSE (ya - yb) / 2 END / 10 AS dy FROM g, n)"""


@query(f"WITH {GRADIENT} SELECT row, col, {r6('dx', 4)} AS dx, {r6('dy', 4)} AS dy FROM gr")
def gradient(spark, d):
    return analysis.gradients(grids.balances(spark, d)).select("row", "col", rounded("dx", 4).alias("dx"), rounded("dy", 4).alias("dy"))


@query(f"WITH {GRADIENT} SELECT row, col, {r6(f32('degrees(atan(sqrt(dx * dx + dy * dy)))'), 3)} AS b1 FROM gr")
def slope(spark, d):
    return grids.balances(spark, d).slope().df.select("row", "col", rounded("b1", 3).alias("b1"))


@query(f"WITH {GRADIENT} SELECT row, col, {r6(f32('greatest(0, cos(radians(45)) * cos(atan(sqrt(dx * dx + dy * dy))) + sin(radians(45)) * sin(atan(sqrt(dx * dx + dy * dy))) * cos(radians(315) - atan2(-dx, dy)))'), 4)} AS b1 FROM gr")
def hillshade(spark, d):
    return grids.balances(spark, d).hillshade().df.select("row", "col", rounded("b1", 4).alias("b1"))


@query(f"WITH {EVT} SELECT e.row, e.col, {r6(f32('avg(CAST(n.b2 AS DOUBLE))'), 3)} AS b1 FROM evt e JOIN evt n ON n.row BETWEEN e.row - 1 AND e.row + 1 AND n.col BETWEEN e.col - 1 AND e.col + 1 GROUP BY 1, 2")
def focal_mean(spark, d):
    return grids.events(spark, d).band(2).focal_mean().df.select("row", "col", rounded("b1", 3).alias("b1"))


@query(f"WITH {CUST}, q AS (SELECT quantile_cont(CAST(b1 AS DOUBLE), [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) AS p FROM cust) SELECT CAST(k / 10.0 AS DOUBLE) AS share, {r6('p[k + 1]', 4)} AS value FROM q, range(11) t(k)")
def hypsometric(spark, d):
    return analysis.hypsometric(grids.balances(spark, d), 11).select("share", rounded("value", 4).alias("value"))


@query(
    f"""WITH {EVT}, s AS (SELECT quantile_cont(CAST(b1 AS DOUBLE), 0.02) AS l1, quantile_cont(CAST(b1 AS DOUBLE), 0.98) AS h1, quantile_cont(CAST(b2 AS DOUBLE), 0.02) AS l2, quantile_cont(CAST(b2 AS DOUBLE), 0.98) AS h2, quantile_cont(CAST(b3 AS DOUBLE), 0.02) AS l3, quantile_cont(CAST(b3 AS DOUBLE), 0.98) AS h3 FROM evt)
SELECT row, col, {r6('CASE WHEN b1 IS NOT NULL THEN least(greatest((b1 - l1) / (h1 - l1), 0), 1) END', 5)} AS red, {r6('CASE WHEN b2 IS NOT NULL THEN least(greatest((b2 - l2) / (h2 - l2), 0), 1) END', 5)} AS green,
{r6('CASE WHEN b3 IS NOT NULL THEN least(greatest((b3 - l3) / (h3 - l3), 0), 1) END', 5)} AS blue, CAST(CASE WHEN b1 IS NOT NULL THEN 1.0 ELSE 0.0 END AS DOUBLE) AS alpha FROM evt, s"""
)
def composite_rgb(spark, d):
    c = viz.composite(grids.events(spark, d), [1, 2, 3])
    return c.select("row", "col", rounded("red", 5).alias("red"), rounded("green", 5).alias("green"), rounded("blue", 5).alias("blue"), "alpha")


@query("SELECT CAST(l_orderkey // 100 AS INTEGER) AS row, CAST(l_orderkey % 100 AS INTEGER) AS col, " + r6("quantile_cont(l_quantity, 0.5)") + " AS quantity, " + r6("quantile_cont(l_extendedprice, 0.5)", 3) + " AS price FROM lineitem GROUP BY 1, 2")
def time_median_composite(spark, d):
    seen = grids.table(spark, d, "lineitem").select(F.expr("cast(l_orderkey div 100 as int)").alias("row"), (F.col("l_orderkey") % 100).cast("int").alias("col"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    c = analysis.composite_observations(seen, "median", ["quantity", "price"])
    return c.select("row", "col", rounded("quantity").alias("quantity"), rounded("price", 3).alias("price"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, CAST(user_id // 20 AS INTEGER) AS row, CAST(user_id % 20 AS INTEGER) AS col, count(*) AS n, count(CASE WHEN event_type <> 'error' THEN value END) AS n_valid, " + r6("avg(CASE WHEN event_type <> 'error' THEN CAST(CAST(value AS FLOAT) AS DOUBLE) END)", 4) + " AS mean FROM events GROUP BY 1, 2, 3")
def windowed_composite(spark, d):
    e = grids.table(spark, d, "events").select(F.expr("cast(user_id div 20 as int)").alias("row"), (F.col("user_id") % 20).cast("int").alias("col"), "ts", F.when(F.col("event_type") != "error", F.col("value").cast("float")).alias("value"))
    w = streaming.windowed_composite(e)
    return w.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "row", "col", "n", "n_valid", rounded("mean", 4).alias("mean"))


@query(over(EVT, "b AS band", "CAST(4200000.0 - 10.0 * (row + 0.5) AS DOUBLE) AS y", "CAST(500000.0 + 10.0 * (col + 0.5) AS DOUBLE) AS x", f"{r6('coalesce(v, -9999)')} AS value", source="(SELECT row, col, 1 AS b, b1 AS v FROM evt UNION ALL SELECT row, col, 2, b2 FROM evt)"))
def to_labelled(spark, d):
    t = _two(spark, d).to_labelled()
    row = F.floor((4200000.0 - F.col("y")) / 10).cast("int")
    return t.select(row.alias("row"), F.floor((F.col("x") - 500000.0) / 10).cast("int").alias("col"), "band", "y", "x", rounded("value").alias("value"))


@query("SELECT CAST(vec_id AS INTEGER) AS row, CAST(i AS INTEGER) AS col, " + r6("embedding[i + 1]") + " AS b1 FROM embeddings, range(64) t(i) WHERE embedding IS NOT NULL")
def tile_array_ingest(spark, d):
    e = grids.table(spark, d, "embeddings").where(F.col("embedding").isNotNull())
    return e.select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "b1")).select("row", "col", rounded("b1").alias("b1"))


@query(f"WITH {EVT} SELECT row, col, {r6('b1')} AS b1 FROM evt")
def nodata_export(spark, d):
    r = grids.events(spark, d).band(1)
    enc = r.encoded()
    return enc.select("row", "col", rounded(F.when(F.col("b1") != -9999, F.col("b1"))).alias("b1"))


# -- storage, decimation and further methods --


@query(f"WITH {EVT} SELECT CAST(row - 2 AS INTEGER) AS row, CAST(col - 10 AS INTEGER) AS col, {r6('b1')} AS b1, {r6('b2')} AS b2, {r6('b3')} AS b3 FROM evt WHERE row BETWEEN 2 AND 7 AND col BETWEEN 10 AND 39")
def stored_tiles_clip(spark, d):
    """Saved as tiles in the shared folder, opened again, clipped: only the tiles of the box are read."""
    path = shared_path(spark)
    grids.events(spark, d).save_raster(path, driver="parquet")
    return pixels(sources.load_raster(path, spark=spark).clip_raster_with_bbox((500100.0, 4199920.0, 500400.0, 4199980.0)))


@query(f"WITH {CUST} SELECT row, col, {r6('b1')} AS b1 FROM cust")
def labelled_round_trip(spark, d):
    return pixels(sources.from_labelled(grids.balances(spark, d).to_labelled(), crs=grids.CRS))


@query(f"WITH {MOSAIC}, m AS (SELECT row, col, arg_max(b1, prio) FILTER (WHERE b1 IS NOT NULL) AS b1 FROM united GROUP BY 1, 2) SELECT g.row, g.col, {r6('b1', 2)} AS b1 FROM g LEFT JOIN m USING (row, col)")
def mosaic_last(spark, d):
    return _mosaic(spark, d, method="last")


@query(f"WITH {MOSAIC}, m AS (SELECT row, col, count(b1) AS b1 FROM united GROUP BY 1, 2) SELECT g.row, g.col, {r6('b1', 2)} AS b1 FROM g LEFT JOIN m USING (row, col)")
def mosaic_count(spark, d):
    return _mosaic(spark, d, method="count")


@query(_half("quantile_cont(CAST(b1 AS DOUBLE), 0.25)"))
def resample_q1(spark, d):
    return _halved(spark, d, "q1")


@query(_half("quantile_cont(CAST(b1 AS DOUBLE), 0.75)"))
def resample_q3(spark, d):
    return _halved(spark, d, "q3")


@query(f"WITH {GRADIENT} SELECT row, col, {r6(f32('(degrees(atan2(-dx, dy)) + 360) % 360'), 2)} AS b1 FROM gr WHERE dx <> 0 OR dy <> 0")
def aspect(spark, d):
    r = grids.balances(spark, d)
    flat = analysis.gradients(r).where("dx = 0 and dy = 0").select("row", "col")
    return r.aspect().df.join(flat, ["row", "col"], "left_anti").select("row", "col", rounded("b1", 2).alias("b1"))


@query(f"WITH {EVT} SELECT row, col, {r6('b1')} AS b1, {r6('b2')} AS b2, {r6('b3')} AS b3 FROM (SELECT CAST(row // 5 AS INTEGER) AS row, CAST(col // 5 AS INTEGER) AS col, b1, b2, b3 FROM evt WHERE row % 5 = 2 AND col % 5 = 2)")
def decimated_read(spark, d):
    e = grids.events(spark, d)
    return pixels(resample.decimate(e, e.meta.height // 5, 20))


@query(f"WITH {ITEMS}, r AS (SELECT k, ts, row_number() OVER (ORDER BY ts NULLS LAST, CAST(k AS VARCHAR)) AS n FROM items WHERE collection = '1-URGENT') SELECT CAST(k AS VARCHAR) AS id, CAST(n AS INTEGER) AS place FROM r WHERE n BETWEEN 11 AND 40")
def items_slice(spark, d):
    part = stac_search("1-URGENT", items=grids.scene_items(spark, d))[10:40]
    return spark.createDataFrame([(item.id, k) for k, item in enumerate(part, 11)], "id string, place int")


@query(f"WITH {EVT} SELECT row, col, b1 > 20 AND b2 < 50 AS both, b1 > 20 OR b2 < 50 AS either, NOT (b1 > 20) AS neither FROM evt WHERE b1 IS NOT NULL")
def mask_algebra(spark, d):
    e = grids.events(spark, d)
    high, low = e.column(1) > 20, e.column(2) < 50
    masks = e.derived([high & low, high | low, ~high], dtype="bool", nodata=None)
    return masks.df.where("b1 is not null").select("row", "col", F.col("b1").alias("both"), F.col("b2").alias("either"), F.col("b3").alias("neither"))


@query(f"WITH {EVT}, z AS (SELECT CASE WHEN b1 > 20 THEN 1 ELSE 0 END AS wet, CASE WHEN b2 > 50 THEN 1 ELSE 0 END AS built FROM evt WHERE b1 IS NOT NULL) SELECT coalesce(wet, -1) AS wet, coalesce(built, -1) AS built, count(*) AS n FROM z GROUP BY CUBE (wet, built)")
def cross_tabulation(spark, d):
    e = grids.events(spark, d)
    both = e.derived([e.column(1), e.column(2)]).df.where("b1 is not null").select((F.col("b1") > 20).cast("int").alias("wet"), (F.col("b2") > 50).cast("int").alias("built"))
    return both.cube("wet", "built").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("wet", F.lit(-1)).alias("wet"), F.coalesce("built", F.lit(-1)).alias("built"), "n")


@query("SELECT CAST(l_orderkey // 100 AS INTEGER) AS row, CAST(l_orderkey % 100 AS INTEGER) AS col, strftime(max(l_shipdate), '%Y-%m-%d') AS day, " + r6("max(l_quantity)") + " AS most FROM lineitem GROUP BY 1, 2")
def latest_observation(spark, d):
    seen = grids.table(spark, d, "lineitem").select(F.expr("cast(l_orderkey div 100 as int)").alias("row"), (F.col("l_orderkey") % 100).cast("int").alias("col"), F.col("l_shipdate").alias("ts"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), F.col("l_quantity").alias("most"))
    latest = analysis.composite_observations(seen, "latest", ["day"])
    return latest.join(analysis.composite_observations(seen, "max", ["most"]), ["row", "col"]).select("row", "col", "day", rounded("most").alias("most"))


# -- arrays, metadata and scenes' assets --


@query(over(EVT, f"{r6('b1')} AS b1", f"{r6('b2')} AS b2", f"{r6('b3')} AS b3"))
def array_round_trip(spark, d):
    """All pixels to an array on the driver, and a raster of that array."""
    e = grids.events(spark, d)
    return pixels(sources.load_array(e.to_array(), transform=e.get_transform(), crs=e.get_crs(), nodata=-9999.0, spark=spark))


@query(f"WITH {EVT} SELECT CAST(row - 2 AS INTEGER) AS row, CAST(col - 10 AS INTEGER) AS col, {r6('b2')} AS b1, {r6('b1')} AS b2 FROM evt WHERE row BETWEEN 2 AND 7 AND col BETWEEN 10 AND 39")
def read_window(spark, d):
    got = grids.events(spark, d).read([2, 1], window=((2, 8), (10, 40)))
    return pixels(sources.load_array(got, nodata=-9999.0, spark=spark))


@query(over(EVT, f"{r6('b2')} AS b1"))
def band_by_name(spark, d):
    return pixels(sources.load_array(grids.events(spark, d).get_band("red"), nodata=-9999.0, spark=spark))


@query(
    """WITH e AS (SELECT CAST(ceil(count(*) / 100.0) AS BIGINT) AS h FROM events)
SELECT key, value FROM e, LATERAL (SELECT unnest(['bands', 'bottom', 'column of a place', 'count', 'crs', 'height', 'left', 'right', 'row of a place', 'top', 'width']) AS key,
unnest(['nir, red, blue', CAST(4200000 - 10 * h AS VARCHAR), '33', '3', 'EPSG:32633', CAST(h AS VARCHAR), '500000', '501000', '2', '4200000', '100']) AS value)"""
)
def raster_metadata(spark, d):
    e = grids.events(spark, d)
    left, bottom, right, top = e.get_bounds()
    row, col = e.get_index()(500335.0, 4199975.0)
    known = {"bands": ", ".join(e.band_names), "bottom": int(bottom), "column of a place": col, "count": e.get_count(), "crs": e.get_crs(), "height": e.get_height(), "left": int(left), "right": int(right), "row of a place": row, "top": int(top), "width": e.get_width()}
    return spark.createDataFrame([(k, str(v)) for k, v in known.items()], "key string, value string")


@query(f"WITH {MOSAIC}, m AS (SELECT row, col, min(b1) AS b1 FROM united GROUP BY 1, 2) SELECT g.row, g.col, {r6('b1', 2)} AS b1 FROM g LEFT JOIN m USING (row, col)")
def mosaic_min(spark, d):
    return _mosaic(spark, d, method="min")


@query(f"WITH {MOSAIC}, m AS (SELECT row, col, sum(CAST(b1 AS DOUBLE)) AS b1 FROM united GROUP BY 1, 2) SELECT g.row, g.col, {r6(f32('b1'), 2)} AS b1 FROM g LEFT JOIN m USING (row, col)")
def mosaic_sum(spark, d):
    return _mosaic(spark, d, method="sum")


def _scene(spark: SparkSession, d: str):
    """A catalogue of one scene: events as a GeoTIFF of one band, and the same halved to 20 m as tiles."""
    e = grids.events(spark, d).band(1)
    fine, coarse = shared_path(spark, ".tif"), shared_path(spark)
    e.save_raster(fine)
    e.resample(size=(-(-e.meta.height // 2), 50), resampling_method="max").save_raster(coarse, driver="parquet")
    row = {"id": "scene", "collection": "events", "bbox": [14.0, 37.0, 16.0, 39.0], "datetime": "2024-06-02T10:00:00Z", "assets": {"nir": fine, "most": coarse}}
    row["geometry"] = {"type": "Polygon", "coordinates": [[[14.0, 37.0], [16.0, 37.0], [16.0, 39.0], [14.0, 39.0], [14.0, 37.0]]]}
    return items_table([row], spark)


#: A place of 6 x 20 pixels inside the scene: rows 2 to 7 and columns 10 to 29 with their edges' neighbours.
def _place():
    from ..functions import projection

    (x0, y0), (x1, y1) = (projection.convert("EPSG:32633", "EPSG:4326", x, y) for x, y in ((500104.0, 4199924.0), (500296.0, 4199976.0)))
    return x0, y0, x1, y1


@query(f"WITH {EVT} SELECT CAST(row - 2 AS INTEGER) AS row, CAST(col - 10 AS INTEGER) AS col, {r6('b1')} AS b1 FROM evt WHERE row BETWEEN 2 AND 7 AND col BETWEEN 10 AND 29")
def item_load_crop(spark, d):
    """An asset's window around a box in longitude and latitude: only the blocks that hold it are read."""
    item = stac_search("events", items=_scene(spark, d))[0]
    return pixels(item.load("nir", bbox=_place(), spark=spark))


HALF_MAX = "h AS (SELECT row // 2 AS r, col // 2 AS c, max(b1) AS m FROM evt GROUP BY 1, 2)"


@query(f"WITH {EVT}, {HALF_MAX} SELECT row, col, {r6('b1')} AS b1, {r6('m')} AS b2 FROM evt JOIN h ON row // 2 = r AND col // 2 = c")
def item_load_grid(spark, d):
    """Assets of two resolutions on the first one's grid."""
    item = stac_search("events", items=_scene(spark, d))[0]
    return pixels(item.load(["nir", "most"], spark=spark))


@query(f"WITH {EVT} SELECT CAST(row - 2 AS INTEGER) AS row, CAST(col - 10 AS INTEGER) AS col, {r6('b1')} AS b1 FROM evt WHERE row BETWEEN 2 AND 7 AND col BETWEEN 10 AND 29")
def item_load_search_area(spark, d):
    """Without a box of its own, an item's load is cut to the search's."""
    item = stac_search("events", items=_scene(spark, d), bbox=_place())[0]
    r = item.load(["nir"], spark=spark)
    assert r.band_names == ["nir"] and r.attrs["stac_item"] == "scene" and item.asset_names == ["most", "nir"]
    return pixels(r)


@query(f"WITH {EVT} SELECT CAST(row - 2 AS INTEGER) AS row, CAST(col - 10 AS INTEGER) AS col, CASE WHEN row BETWEEN 2 AND 7 AND col BETWEEN 10 AND 29 THEN {r6('b1')} END AS b1 FROM evt WHERE row BETWEEN 2 AND 7 AND col BETWEEN 10 AND 29")
def item_load_mask(spark, d):
    """Pixels outside the search's outline are nodata."""
    x0, y0, x1, y1 = _place()
    outline = {"type": "Polygon", "coordinates": [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]}
    item = stac_search("events", items=_scene(spark, d), intersects=outline)[0]
    return pixels(item.load("nir", mask=True, spark=spark))
