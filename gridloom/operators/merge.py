"""Mosaics and stacks."""

from __future__ import annotations

import functools
import math
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import contract
from ..errors import AlignmentError, CRSMismatchError, ValidationError
from ..meta import Affine
from ..raster import Raster, raster_op
from .algebra import together
from .resample import normalize_resampling_method, onto, whole

METHODS = ("first", "last", "min", "max", "sum", "count")


def _placed(ds: Raster, t: Affine, height: int, width: int, method: str, nodata: Any) -> DataFrame:
    """A raster's pixels on the mosaic's grid: shifted if they lie on it, else resampled."""
    s = ds.meta.transform
    if s.rotated or t.rotated:
        raise AlignmentError("rotated rasters can't be put together")
    dc, dr = (s.c - t.c) / t.a, (s.f - t.f) / t.e
    same = math.isclose(s.a, t.a, rel_tol=1e-6) and math.isclose(s.e, t.e, rel_tol=1e-6)
    if same and abs(dc - round(dc)) < 1e-3 and abs(dr - round(dr)) < 1e-3:
        names = [F.col(f"b{i}") for i in range(1, ds.meta.count + 1)]
        return ds.df.select((F.col("row") + round(dr)).cast("int").alias("row"), (F.col("col") + round(dc)).cast("int").alias("col"), *names)
    return onto(ds, height, width, (abs(s.e), abs(t.e), (t.f - s.f) / s.e), (abs(s.a), abs(t.a), (t.c - s.c) / s.a), method)


@raster_op(preserve_none=True, propagate_band_names=False)  # a saved mosaic gives None
def mosaic(
    ds: Raster, others: Any, *, resampling_method: Any = "nearest", save_path: str | None = None, auto_reproject: bool = False, names: Any = None, method: str = "first", bounds: tuple[float, float, float, float] | None = None, res: Any = None, nodata: float | None = None, indexes: list[int] | None = None
) -> Raster | None:
    """All rasters over their joint extent on ds's grid; where they overlap the first valid pixel wins, or ``method``.

    One aggregation over the union of pixels, so any number of rasters costs one shuffle.
    """
    others = [others] if isinstance(others, Raster) else list(others or [])
    if not others or not all(isinstance(o, Raster) for o in others):
        raise ValidationError("at least one other raster is needed")
    if method not in METHODS:
        raise ValidationError(f"method is one of {METHODS}")
    resampling = normalize_resampling_method(resampling_method)
    parts = [ds]
    for o in others:
        if o.meta.crs != ds.meta.crs:
            if not auto_reproject:
                raise CRSMismatchError(f"rasters lie in {ds.meta.crs} and {o.meta.crs}; auto_reproject is off")
            o = o.reproject_raster(target_crs=ds.meta.crs, resampling_method=resampling)
        parts.append(o)
    if indexes is not None:
        parts = [p.derived([p.column(i) for i in indexes], band_names=tuple(p.meta.band_names[p.meta.band_index(i) - 1] for i in indexes)) for p in parts]
    count = parts[0].meta.count
    if any(p.meta.count != count for p in parts):
        raise ValidationError("all rasters have as many bands")
    t = parts[0].meta.transform
    xres, yres = (abs(t.a), abs(t.e)) if res is None else ((float(res), float(res)) if isinstance(res, (int, float)) else tuple(map(float, res)))
    boxes = [p.meta.bounds for p in parts]
    x0, y0, x1, y1 = bounds or (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes))
    width, height = max(1, round((x1 - x0) / xres)), max(1, round((y1 - y0) / yres))
    grid = Affine.from_origin(x0, y1, xres, yres)
    bands = [f"b{i}" for i in range(1, count + 1)]
    kind = contract.storage(ds.meta.dtype)
    tables = [_placed(p, grid, height, width, resampling, nodata).select("row", "col", *[F.col(b).cast(kind).alias(b) for b in bands], F.lit(k).alias("prio")) for k, p in enumerate(parts)]
    union = functools.reduce(DataFrame.unionByName, tables).where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    pick = {
        "first": lambda b: F.min_by(b, F.when(F.col(b).isNotNull(), F.col("prio"))),
        "last": lambda b: F.max_by(b, F.when(F.col(b).isNotNull(), F.col("prio"))),
        "min": lambda b: F.min(b),
        "max": lambda b: F.max(b),
        "sum": lambda b: F.sum(b).cast(kind) if not contract.is_integer(ds.meta.dtype) else contract.wrap(F.sum(F.col(b).cast("bigint")), ds.meta.dtype),
        "count": lambda b: F.count(b).cast(kind),
    }[method]
    merged = union.groupBy("row", "col").agg(*[pick(b).alias(b) for b in bands])
    full = whole(ds.spark, height, width).join(merged, ["row", "col"], "left")
    out = ds.replaced(full, height=height, width=width, transform=grid, count=count, nodata=ds.meta.nodata if nodata is None else nodata, band_names=tuple(names) if names is not None else parts[0].meta.band_names)
    if save_path is not None:
        out.save_raster(save_path)
        return None
    return out


@raster_op(propagate_band_names=False)
def stack(ds: Raster, others: Any, *, names: Any = None) -> Raster:
    """The bands of all rasters of one grid in one raster. nodata is ds's; other rasters' sentinels become plain values."""
    others = [others] if isinstance(others, Raster) else list(others or [])
    if not others or not all(isinstance(o, Raster) for o in others):
        raise ValidationError("at least one other raster is needed")
    for o in others:
        if o.meta.crs != ds.meta.crs:
            raise CRSMismatchError(f"rasters lie in {ds.meta.crs} and {o.meta.crs}")
        if not ds.meta.same_grid(o.meta):
            raise AlignmentError(f"grids differ: {ds.meta.shape} and {o.meta.shape}")
    parts = [ds, *others]
    dtype = np.result_type(*[np.dtype(p.meta.dtype) for p in parts]).name
    kind = contract.storage(dtype)
    base, exprs = together(*parts)
    out = []
    for p, bands in zip(parts, exprs, strict=True):
        for e in bands:
            stored = contract.encode(e, p.meta.nodata, p.meta.dtype).cast(kind)
            out.append((e.cast(kind) if p is ds else contract.decode(stored, ds.meta.nodata, dtype)))
    known = [n for p in parts for n in p.meta.band_names]
    names = tuple(names) if names is not None else (tuple(known) if any(known) else ())
    if base is ds._base:
        return ds.derived(out, dtype=dtype, nodata=ds.meta.nodata, band_names=names)
    return ds.replaced(base.select("row", "col", *[e.alias(f"b{i}") for i, e in enumerate(out, 1)]), dtype=dtype, count=len(out), nodata=ds.meta.nodata, band_names=names)
