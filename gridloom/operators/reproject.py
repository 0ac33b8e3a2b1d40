"""Reprojection: kernel methods by an approximated transformer on tiles (``warp``), nearest there at exact places, area methods by column formulas."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions import projection
from ..functions.crs import definition
from ..meta import Affine, clean_crs
from ..raster import Raster, raster_op
from .resample import AREA, combined, normalize_resampling_method, whole
from .warp import TOLERANCE, warped


def target_grid(ds: Raster, crs: str) -> tuple[int, int, Affine]:
    """(height, width, transform) that keep the number of pixels along the raster's diagonal."""
    m = ds.meta
    x0, y0, x1, y1 = projection.convert_bounds(m.crs, crs, m.bounds)
    size = math.hypot(x1 - x0, y1 - y0) / math.hypot(m.height, m.width)
    width, height = max(1, math.ceil((x1 - x0) / size - 1e-6)), max(1, math.ceil((y1 - y0) / size - 1e-6))
    return height, width, Affine.from_origin(x0, y1, size, size)


def warp(ds: Raster, height: int, width: int, transform: Affine, crs: str | None, method: str, tolerance: float = TOLERANCE) -> DataFrame:
    """row, col, b1 ... of every pixel of a target grid. Area methods put together the source pixels whose centres fall into a pixel."""
    if method not in AREA:
        return warped(ds, height, width, transform, crs, method, tolerance)
    names = [f"b{k}" for k in range(1, ds.meta.count + 1)]
    t = ds.meta.transform
    c, r = F.col("col") + 0.5, F.col("row") + 0.5
    x, y = c * t.a + r * t.b + t.c, c * t.d + r * t.e + t.f
    df, x, y = projection.convert_columns(ds.df, ds.meta.crs, crs, x, y) if crs != ds.meta.crs else (ds.df, x, y)
    df, i = df.withColumns({"__x": x, "__y": y}), transform.inverse()
    # never null, so that the join infers no filter that would be pushed down and compute the places once more
    place = lambda a, b, c: F.coalesce(F.floor(F.col("__x") * a + F.col("__y") * b + c).cast("int"), F.lit(-1))
    at = df.select(place(i.d, i.e, i.f).alias("row"), place(i.a, i.b, i.c).alias("col"), F.lit(1.0).alias("w"), *names)
    return whole(ds.spark, height, width).join(combined(at, method, ds.meta.dtype, ds.meta.count), ["row", "col"], "left")


def warp_onto(ds: Raster, target: Raster, method: Any = "nearest", tolerance: float = TOLERANCE) -> Raster:
    """ds on the grid of a raster of any CRS and direction; pixels that ds doesn't reach are NULL."""
    m = target.meta
    if (ds.meta.crs is None) != (m.crs is None):
        raise ValidationError("both rasters have a CRS, or neither has")
    df = warp(ds, m.height, m.width, m.transform, m.crs, normalize_resampling_method(method), tolerance)
    return ds.replaced(df, height=m.height, width=m.width, transform=m.transform, crs=m.crs)


@raster_op
def reproject_raster(ds: Raster, *, target_crs: Any, resampling_method: Any = "nearest", tolerance: float = TOLERANCE) -> Raster:
    """The raster in another CRS. Pixels that the source doesn't reach are nodata, or 0 on export where none is declared.

    ``tolerance``: by how many source pixels a place may err (kernel methods); 0 transforms every pixel exactly, as nearest always does.
    """
    if not isinstance(target_crs, (int, str)) and not hasattr(target_crs, "to_string") or isinstance(target_crs, bool):
        raise ValidationError("a CRS is a code or a string")
    crs = clean_crs(target_crs)
    if ds.meta.crs is None:
        raise ValidationError("the raster has no CRS")
    definition(crs), definition(ds.meta.crs)
    height, width, transform = target_grid(ds, crs)
    df = warp(ds, height, width, transform, crs, normalize_resampling_method(resampling_method), tolerance)
    return ds.replaced(df, height=height, width=width, transform=transform, crs=crs)
