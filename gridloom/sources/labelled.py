"""Labelled tables (band, y, x, value) with pixel centre coordinates, and labelled arrays of the same shape."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .._optional import import_optional
from ..errors import ValidationError
from ..meta import Affine, RasterMeta
from ..raster import Raster, raster_op
from .arrays import load_array

#: How far steps of an axis may differ.
EVEN = 1e-3


def _utc(value: datetime | None) -> datetime | None:
    """UTC without a zone."""
    return value.astimezone(timezone.utc).replace(tzinfo=None) if value is not None and value.tzinfo else value


@raster_op
def to_labelled(ds: Raster) -> DataFrame:
    """band, band_name, y, x, time, value: one row per pixel and band, coordinates of centres, nodata as stored."""
    t, m = ds.meta.transform, ds.meta
    c, r = F.col("col") + 0.5, F.col("row") + 0.5
    wide = ds.encoded()
    each = F.array(*[F.struct(F.lit(i).alias("band"), F.lit(m.band_names[i - 1]).cast("string").alias("band_name"), F.col(f"b{i}").alias("value")) for i in range(1, m.count + 1)])
    return wide.select((c * t.d + r * t.e + t.f).alias("y"), (c * t.a + r * t.b + t.c).alias("x"), F.explode(each).alias("z")).select("z.band", "z.band_name", "y", "x", F.lit(_utc(m.timestamp)).cast("timestamp_ntz").alias("time"), "z.value")


def _axis(df: DataFrame, name: str) -> tuple[float, float, int]:
    """(first, step, number) of an evenly spaced axis in its stored direction: x ascends, y descends."""
    ascending = name == "x"
    w = Window.orderBy(F.col(name) if ascending else F.col(name).desc())  # the distinct values of one axis
    values = df.select(name).where(F.col(name).isNotNull()).distinct()
    steps = values.withColumn("d", F.lead(name).over(w) - F.col(name))
    r = steps.agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("lo"), F.max(name).alias("hi"), F.min("d").alias("d0"), F.max("d").alias("d1")).first()
    if not r.n:
        raise ValidationError(f"axis {name} is empty")
    if r.n == 1:
        return r.lo, 1.0 if ascending else -1.0, 1
    step = (r.hi - r.lo) / (r.n - 1) * (1 if ascending else -1)
    if max(abs(r.d0 - step), abs(r.d1 - step)) > EVEN * abs(step):
        raise ValidationError(f"axis {name} isn't evenly spaced")
    return (r.lo if ascending else r.hi), step, r.n


def from_labelled(df: DataFrame, *, dtype: str = "float32", crs: Any = None, nodata: float | None = None, timestamp: datetime | None = None, attrs: dict | None = None, x: str = "x", y: str = "y", band: str = "band", value: str = "value") -> Raster:
    """A raster of a labelled table: the grid follows from the coordinates. A table of several times is refused."""
    t = df.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(band).cast("int").alias("band"), F.col(value).alias("value"), *([F.col("time")] if "time" in df.columns else []))
    if "time" in df.columns:
        times = t.agg(F.count_distinct("time").alias("n"), F.max("time").alias("t")).first()
        if times.n > 1:
            raise ValidationError("a raster has one time")
        timestamp = timestamp or times.t
    x0, dx, width = _axis(t, "x")
    y0, dy, height = _axis(t, "y")
    bands = [r.band for r in t.select("band").distinct().orderBy("band").collect()]  # as many as the raster has bands
    meta = RasterMeta(height, width, dtype, len(bands), Affine(dx, 0, x0 - dx / 2, 0, dy, y0 - dy / 2), crs, nodata, (), _utc(timestamp), attrs or {})
    at = t.select(F.round((F.col("y") - y0) / dy).cast("int").alias("row"), F.round((F.col("x") - x0) / dx).cast("int").alias("col"), "band", "value")
    wide = at.groupBy("row", "col").agg(*[F.max(F.when(F.col("band") == b, F.col("value"))).alias(f"b{i}") for i, b in enumerate(bands, 1)])
    return Raster.from_table(wide, meta)


@raster_op
def to_xarray(ds: Raster) -> Any:
    """A DataArray (band, y, x) of all pixels, if that library is installed."""
    xr = import_optional("xarray", "to_xarray")
    t, m = ds.meta.transform, ds.meta
    coords: dict[str, Any] = {"band": np.arange(1, m.count + 1)}
    if t.rotated:
        c, r = np.meshgrid(np.arange(m.width) + 0.5, np.arange(m.height) + 0.5)
        coords |= {"xc": (("y", "x"), t.a * c + t.b * r + t.c), "yc": (("y", "x"), t.d * c + t.e * r + t.f)}
    else:
        coords |= {"x": t.a * (np.arange(m.width) + 0.5) + t.c, "y": t.e * (np.arange(m.height) + 0.5) + t.f}
    if m.timestamp is not None:
        coords["time"] = np.datetime64(_utc(m.timestamp), "us")
    attrs = {k: v for k, v in m.attrs.items() if k not in ("crs", "transform", "nodata", "_FillValue", "long_name")}
    attrs |= {"crs": m.crs, "transform": tuple(t)} | ({"nodata": m.nodata} if m.nodata is not None else {}) | ({"long_name": tuple(n or "" for n in m.band_names)} if any(m.band_names) else {})
    return xr.DataArray(ds.to_array(), dims=("band", "y", "x"), coords=coords, attrs=attrs)


def from_xarray(da: Any, spark: Any = None) -> Raster:
    """A raster of a DataArray-like object: dims, coords, values, attrs. Axes outrank a stored transform that disagrees."""
    if not hasattr(da, "dims") or not hasattr(da, "values"):
        raise ValidationError("a DataArray is needed")
    if hasattr(da, "data_vars"):
        raise ValidationError("a Dataset holds several arrays: pick one of them")
    values, dims = np.asarray(da.values), [str(d) for d in da.dims]
    coords = {k: np.asarray(getattr(v, "values", v)) for k, v in dict(da.coords).items()}
    attrs = dict(getattr(da, "attrs", {}) or {})
    names_x, names_y = {"x", "lon", "longitude", "easting"}, {"y", "lat", "latitude", "northing"}
    dx = next((d for d in dims if d.lower() in names_x), None)
    dy = next((d for d in dims if d.lower() in names_y), None)
    if dx is None or dy is None:
        raise ValidationError(f"no x and y among the dimensions {dims}")
    rest = [d for d in dims if d not in (dx, dy)]
    long = [d for d in rest if values.shape[dims.index(d)] > 1]
    if any(d.lower() == "time" for d in long):
        raise ValidationError("a raster has one time")
    if len(long) > 1:
        raise ValidationError(f"more than one band dimension: {long}")
    order = [dims.index(d) for d in [*[d for d in rest if d not in long], *long, dy, dx]]
    values = values.transpose(order).reshape((-1, values.shape[dims.index(dy)], values.shape[dims.index(dx)]))
    stored = Affine.of(attrs["transform"]) if attrs.get("transform") is not None else None

    def axis(name: str) -> tuple[float, float] | None:
        c = coords.get(name)
        if c is None or c.ndim != 1:
            return None
        if len(c) == 1:
            return (float(c[0]), stored.a if name == dx else stored.e) if stored else (float(c[0]), 1.0 if name == dx else -1.0)
        d = np.diff(c.astype(float))
        step = float(d.mean())
        if step == 0 or np.abs(d - step).max() > EVEN * abs(step):
            raise ValidationError(f"axis {name} isn't evenly spaced")
        return float(c[0]), step

    ax, ay = axis(dx), axis(dy)
    if ax and ay:
        t = Affine(ax[1], 0, ax[0] - ax[1] / 2, 0, ay[1], ay[0] - ay[1] / 2)
        if stored and np.allclose(tuple(t), tuple(stored), rtol=1e-9, atol=1e-9):
            t = stored
    elif stored:
        t = stored
    else:
        raise ValidationError("neither coordinates nor a transform place the array")
    time = coords.get("time")
    timestamp = None
    if time is not None and time.size == 1 and not np.isnat(time.astype("datetime64[us]").ravel()[0]):
        timestamp = time.astype("datetime64[us]").ravel()[0].item()
    names = attrs.get("long_name")
    names = tuple(names) if isinstance(names, (list, tuple)) and len(names) == len(values) else ((names,) if isinstance(names, str) and len(values) == 1 else ())
    nodata = attrs.get("nodata", attrs.get("_FillValue"))
    free = {k: v for k, v in attrs.items() if k not in ("crs", "transform", "nodata", "_FillValue", "long_name")}
    return load_array(values, transform=t, crs=attrs.get("crs"), nodata=nodata, timestamp=_utc(timestamp), attrs=free, band_names=names, spark=spark)
