"""Statistics with positions, descriptions and point samples: aggregations over one scan of the bands they need."""

from __future__ import annotations

import math
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contract
from ..errors import ValidationError
from ..functions.quantiles import percentiles
from ..raster import Raster, raster_op

#: Pixels a side that approximate statistics read.
APPROX_SIDE = 1024


def valid(col: Column, dtype: str) -> Column:
    """A band for statistics: NaN don't count, whether or not nodata is declared."""
    return F.nanvl(col, F.lit(None).cast(contract.storage(dtype))) if not contract.is_integer(dtype) and dtype != "bool" else col


def band_table(ds: Raster, band: Any) -> DataFrame:
    """row, col, v of one band."""
    return ds._base.select("row", "col", valid(ds.column(band), ds.meta.dtype).alias("v"))


def _positioned(ds: Raster, band: Any, key: str, value: Any, row: Any, col: Any, as_pixel: bool) -> dict:
    if row is None:
        raise ValidationError("the band has no valid pixel")
    where = (int(row), int(col)) if as_pixel else ds.meta.transform.point(col, row)
    return {key: value, "position": where}


def extremum(ds: Raster, band: Any, largest: bool) -> DataFrame:
    """v, row, col of the largest or smallest pixel, the first in row-major order among equals. One row."""
    t = band_table(ds, band)
    key = F.struct("v", -F.col("row"), -F.col("col")) if largest else F.struct("v", "row", "col")
    pick = F.max_by if largest else F.min_by
    return t.agg(pick(F.struct("v", "row", "col"), F.when(F.col("v").isNotNull(), key)).alias("z")).select("z.*")


def nearest_to(ds: Raster, band: Any, target: DataFrame) -> DataFrame:
    """value, v, row, col: the pixel nearest to the value of a one-row table (value)."""
    t = band_table(ds, band).crossJoin(F.broadcast(target))
    key = F.struct(F.abs(F.col("v") - F.col("value")), "row", "col")
    return t.agg(F.min_by(F.struct("value", "v", "row", "col"), F.when(F.col("v").isNotNull(), key)).alias("z")).select("z.*")


@raster_op
def extract_value_at_coordinate(ds: Raster, coordinate: tuple[float, float], band_idx: Any = 1) -> Any:
    """The value at (x, y); NaN where it is nodata."""
    if not isinstance(coordinate, (tuple, list)) or len(coordinate) != 2:
        raise ValidationError("a coordinate is (x, y)")
    row, col = ds.get_index()(*coordinate)
    if not (0 <= row < ds.meta.height and 0 <= col < ds.meta.width):
        raise ValidationError(f"{tuple(coordinate)} lies outside the raster")
    got = band_table(ds, band_idx).where((F.col("row") == row) & (F.col("col") == col)).select("v").first()
    return math.nan if got is None or got.v is None else np.dtype(ds.meta.dtype).type(got.v)


def sample_points(ds: Raster, points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Points with the bands at their places (NULL outside and at nodata), by one equi-join on (row, col)."""
    i = ds.meta.transform.inverse()
    at = points.withColumn("row", F.floor(F.lit(i.d) * F.col(x) + F.lit(i.e) * F.col(y) + F.lit(i.f)).cast("int")).withColumn("col", F.floor(F.lit(i.a) * F.col(x) + F.lit(i.b) * F.col(y) + F.lit(i.c)).cast("int"))
    return at.join(ds.df, ["row", "col"], "left")


@raster_op
def get_maximum_pixel(ds: Raster, band_idx: Any = 1, *, return_position_as_pixel_coordinate: bool = False) -> dict:
    """The largest value and its position: the pixel's upper left corner, or (row, col)."""
    r = extremum(ds, band_idx, True).first()
    return _positioned(ds, band_idx, "maximum", r.v, r.row, r.col, return_position_as_pixel_coordinate)


@raster_op
def get_minimum_pixel(ds: Raster, band_idx: Any = 1, *, return_position_as_pixel_coordinate: bool = False) -> dict:
    """The smallest value and its position."""
    r = extremum(ds, band_idx, False).first()
    return _positioned(ds, band_idx, "minimum", r.v, r.row, r.col, return_position_as_pixel_coordinate)


@raster_op
def get_mean_pixel(ds: Raster, band_idx: Any = 1, *, return_position_as_pixel_coordinate: bool = False) -> dict:
    """The mean and the position of the first pixel nearest to it."""
    r = nearest_to(ds, band_idx, band_table(ds, band_idx).agg(F.avg("v").alias("value"))).first()
    return _positioned(ds, band_idx, "mean", r.value, r.row, r.col, return_position_as_pixel_coordinate)


@raster_op
def get_percentile_pixel(ds: Raster, percentile: float, band_idx: Any = 1, *, return_position_as_pixel_coordinate: bool = False) -> dict:
    """The linearly interpolated percentile and the position of the first pixel nearest to it."""
    if not 0 <= percentile <= 100:
        raise ValidationError("percentiles lie in [0, 100]")
    target = percentiles(band_table(ds, band_idx).select(F.lit(1).alias("g"), F.col("v").cast("double").alias("v")), [percentile / 100], ds.meta.height * ds.meta.width).select(F.col("p")[0].alias("value"))
    r = nearest_to(ds, band_idx, target).first()
    return _positioned(ds, band_idx, "percentile", r.value, r.row, r.col, return_position_as_pixel_coordinate)


def band_statistics(ds: Raster, approx: bool = False) -> DataFrame:
    """band, n_valid, n_nodata, valid_percent, minimum, maximum, mean, std (population): all bands in one pass."""
    from .resample import decimate

    if approx:
        scale = min(1.0, APPROX_SIDE / ds.meta.height, APPROX_SIDE / ds.meta.width)
        ds = decimate(ds, max(1, round(ds.meta.height * scale)), max(1, round(ds.meta.width * scale)))
    aggs = []
    for i, e in enumerate(ds._exprs, 1):
        v = valid(e, ds.meta.dtype)
        aggs.append(F.struct(F.lit(i).alias("band"), F.count(v).alias("n_valid"), F.count(F.lit(1)).alias("n"), F.min(v).cast("double").alias("minimum"), F.max(v).cast("double").alias("maximum"), F.avg(v.cast("double")).alias("mean"), F.stddev_pop(v.cast("double")).alias("std")))
    rows = ds._base.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("z")).select("z.*")
    return rows.select("band", "n_valid", (F.col("n") - F.col("n_valid")).alias("n_nodata"), F.when(F.col("n") > 0, 100.0 * F.col("n_valid") / F.col("n")).alias("valid_percent"), "minimum", "maximum", "mean", "std")


@raster_op(preserve_none=True)
def describe(ds: Raster, *, stats: bool | str = False) -> None:
    """Prints the metadata; ``stats``: True or 'approx' also statistics of a decimated read, 'exact' of all pixels."""
    if stats not in (False, True, "approx", "exact"):
        raise ValidationError("stats is False, True, 'approx' or 'exact'")
    m = ds.meta
    lines = [repr(ds), f"  bounds: {m.bounds}", f"  transform: {tuple(m.transform)}", f"  timestamp: {m.timestamp}", f"  attrs: {m.attrs}"]
    if stats:
        small = m.height <= APPROX_SIDE and m.width <= APPROX_SIDE
        exact = stats == "exact" or small
        lines.append(f"  statistics ({'exact' if exact else 'approximate'}):")
        for r in band_statistics(ds, approx=not exact).collect():  # a row per band
            name = m.band_names[r.band - 1]
            head = f"    band {r.band}{f' ({name})' if name else ''}: "
            lines.append(head + ("all nodata" if not r.n_valid else f"min {r.minimum:g}, max {r.maximum:g}, mean {r.mean:g}, std {r.std:g}, valid {r.valid_percent:.2f}%, nodata {r.n_nodata}"))
    print("\n".join(lines))
