"""Clipping: a range filter for boxes, per-row column intervals for polygons."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import functions as F

from .. import contract
from ..errors import ValidationError
from ..functions import geometry, projection
from ..raster import Raster, raster_op
from .tiles import TILE

def window_of(ds: Raster, row: int, col: int, height: int, width: int) -> Raster:
    """The pixels of a window inside the raster, as a raster of their own. Stored tiles outside it aren't read."""
    base = ds._reader(row, row + height - 1, col, col + width - 1) if ds._reader else ds._base
    keep = F.col("row").between(row, row + height - 1) & F.col("col").between(col, col + width - 1)
    if {"tile_row", "tile_col"} <= set(base.columns):  # the optimiser can't derive these from row and col
        keep = keep & F.col("tile_row").between(row // TILE, (row + height - 1) // TILE) & F.col("tile_col").between(col // TILE, (col + width - 1) // TILE)
    for key in (c for c in base.columns if c.startswith("__key_")):  # a row-major pixel number: whole grid rows are a range
        span = int(key.removeprefix("__key_"))
        keep = keep & (F.col(key) >= row * span) & (F.col(key) < (row + height) * span)
    bands = [e.alias(f"b{i}") for i, e in enumerate(ds._exprs, 1)]
    df = base.where(keep).select((F.col("row") - row).cast("int").alias("row"), (F.col("col") - col).cast("int").alias("col"), *bands)
    return ds.replaced(df, height=height, width=width, transform=ds.meta.transform.shifted(col, row))


def box_window(ds: Raster, box: tuple[float, float, float, float], outward: bool = False) -> tuple[int, int, int, int]:
    """(row, col, height, width) of a box, cut to the raster: rounded to whole pixels, or widened to them."""
    if len(tuple(box)) != 4:
        raise ValidationError("a box is (min x, min y, max x, max y)")
    x0, y0, x1, y1 = map(float, box)
    if not (x0 < x1 and y0 < y1):
        raise ValidationError("the box is empty")
    inverse = ds.meta.transform.inverse()
    points = [inverse.point(x, y) for x in (x0, x1) for y in (y0, y1)]
    c0, c1 = min(p[0] for p in points), max(p[0] for p in points)
    r0, r1 = min(p[1] for p in points), max(p[1] for p in points)
    if outward:
        col, row = math.floor(c0 + 1e-6), math.floor(r0 + 1e-6)
        end_col, end_row = math.ceil(c1 - 1e-6), math.ceil(r1 - 1e-6)
    else:
        col, row = math.floor(c0 + 0.001), math.floor(r0 + 0.001)
        end_col, end_row = col + math.floor(c1 - c0 + 0.5), row + math.floor(r1 - r0 + 0.5)
    row, col, end_row, end_col = max(0, row), max(0, col), min(ds.meta.height, end_row), min(ds.meta.width, end_col)
    if row >= end_row or col >= end_col:
        raise ValidationError("the box holds no pixel of the raster")
    return row, col, end_row - row, end_col - col


@raster_op
def clip_raster_with_bbox(ds: Raster, bbox: tuple[float, float, float, float], plot_kwargs: Any = None, show_preview: bool = False) -> Raster:
    """The pixels of a box in the raster's CRS."""
    return window_of(ds, *box_window(ds, bbox))


@raster_op
def clip_raster_with_vector(
    ds: Raster, vector_file: Any, *, crop: bool = True, pad: bool = False, all_touched: bool = False, invert: bool = False, nodata: float | None = None, vector_crs: Any = None, show_preview: bool = False, plot_kwargs: Any = None
) -> Raster:
    """Pixels outside the polygons (``invert``: inside) become nodata; ``crop`` cuts the grid to the polygons' bounds.

    Geometry is GeoJSON in any form; ``vector_crs``, or the CRS it names, is reprojected to the raster's. Where neither the
    raster nor ``nodata`` gives a nodata value, outside pixels become 0, as integers do on export.
    """
    if crop and invert:
        raise ValidationError("a crop can't be inverted")
    shapes = geometry.polygons(vector_file)
    source = geometry.clean_crs(vector_crs) or geometry.declared_crs(vector_file)
    if source and ds.meta.crs and source != ds.meta.crs:
        shapes = geometry.moved(shapes, lambda x, y: projection.convert(source, ds.meta.crs, x, y))
    if crop:
        x0, y0, x1, y1 = geometry.bounds(shapes)
        if pad:
            px, py = abs(ds.meta.transform.a) / 2, abs(ds.meta.transform.e) / 2
            x0, y0, x1, y1 = x0 - px, y0 - py, x1 + px, y1 + py
        ds = window_of(ds, *box_window(ds, (x0, y0, x1, y1), outward=True))
    out = ds.meta.nodata if nodata is None else nodata
    spans = geometry.covered_rows(geometry.edges(ds.spark, shapes, ds.meta.transform), ds.meta.height, all_touched)
    keep = geometry.within(F.col("col"), F.col("spans"))
    joined = ds._base.join(spans, F.col("row") == F.col("__row"), "left")
    fill = F.lit(None) if out is not None else F.lit(0)
    kind = contract.storage(ds.meta.dtype)
    exprs = [F.when(~keep if invert else keep, e).otherwise(fill.cast(kind)).alias(f"b{i}") for i, e in enumerate(ds._exprs, 1)]
    return ds.replaced(joined.select("row", "col", *exprs), nodata=out)
