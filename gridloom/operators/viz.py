"""What plots draw, as tables: stretches, histograms, composites. Rendering is left to the user's plotting library."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.quantiles import percentiles
from ..raster import Raster, raster_viz
from .resample import decimate
from .stats import valid

#: Displayed pixels per figure pixel.
OVERSAMPLING = 2.0


def display_shape(ds: Raster, figsize: tuple[float, float] | None, dpi: int) -> tuple[int, int]:
    """The decimated shape that a figure needs."""
    w, h = figsize or (6.0, 6.0)
    scale = min(1.0, w * dpi * OVERSAMPLING / ds.meta.width, h * dpi * OVERSAMPLING / ds.meta.height)
    return max(1, round(ds.meta.height * scale)), max(1, round(ds.meta.width * scale))


def auto_grid(n: int, nrows: int | None = None, ncols: int | None = None) -> tuple[int, int]:
    """Rows and columns of n panels."""
    if nrows and ncols:
        if nrows * ncols < n:
            raise ValidationError(f"{nrows} x {ncols} panels don't hold {n} bands")
        return nrows, ncols
    if nrows:
        return nrows, math.ceil(n / nrows)
    if ncols:
        return math.ceil(n / ncols), ncols
    rows = max(1, math.isqrt(n))
    return rows, math.ceil(n / rows)


def stretch_limits(ds: Raster, bands: list[Any] | None = None, pmin: float = 2, pmax: float = 98) -> DataFrame:
    """band, low, high: percentiles of valid pixels; NULL for a band without any, or a constant one."""
    if not 0 <= pmin < pmax <= 100:
        raise ValidationError("percentiles ascend within [0, 100]")
    which = [ds.meta.band_index(b) for b in bands] if bands else list(range(1, ds.meta.count + 1))
    each = F.array(*[F.struct(F.lit(i).alias("g"), valid(ds.column(i), ds.meta.dtype).cast("double").alias("v")) for i in which])
    rows = percentiles(ds._base.select(F.explode(each).alias("z")).select("z.*"), [pmin / 100, pmax / 100], ds.meta.height * ds.meta.width).withColumnRenamed("g", "band")
    fit = F.col("p")[1] > F.col("p")[0]
    return rows.select("band", F.when(fit, F.col("p")[0]).alias("low"), F.when(fit, F.col("p")[1]).alias("high"))


def stretched(ds: Raster, bands: list[Any] | None = None, pmin: float = 2, pmax: float = 98) -> DataFrame:
    """row, col, d1 ...: display values in [0, 1]; constant bands 0, nodata NULL."""
    which = [ds.meta.band_index(b) for b in bands] if bands else list(range(1, ds.meta.count + 1))
    limits = stretch_limits(ds, which, pmin, pmax).groupBy().agg(*[F.max(F.when(F.col("band") == i, F.col(n))).alias(f"__{n}{i}") for i in set(which) for n in ("low", "high")])
    joined = ds._base.crossJoin(F.broadcast(limits))
    out = []
    for k, i in enumerate(which, 1):
        v, low, high = valid(ds.column(i), ds.meta.dtype).cast("double"), F.col(f"__low{i}"), F.col(f"__high{i}")
        out.append(F.when(v.isNull(), F.lit(None)).when(low.isNull(), F.lit(0.0)).otherwise(F.least(F.greatest((v - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).alias(f"d{k}"))
    return joined.select("row", "col", *out)


def histogram(ds: Raster, band: Any = 1, bins: int = 256) -> DataFrame:
    """bin, low, high, n: equal-width counts over valid pixels, the last bin closed; a constant band is widened by one half."""
    if bins < 1:
        raise ValidationError("at least one bin is needed")
    t = ds._base.select(valid(ds.column(band), ds.meta.dtype).cast("double").alias("v")).where(F.col("v").isNotNull())
    limits = t.agg(F.min("v").alias("a"), F.max("v").alias("b")).select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("lo"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("hi")).where(F.col("lo").isNotNull())
    width = (F.col("hi") - F.col("lo")) / bins
    counts = t.crossJoin(F.broadcast(limits)).groupBy(F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / width).cast("int")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = ds.spark.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(limits))
    return every.join(F.broadcast(counts), "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _decimated(ds: Raster, figsize: Any, dpi: int) -> Raster:
    return decimate(ds, *display_shape(ds, figsize, dpi))


@raster_viz
def plot_band_array(ds: Raster, bands: Any = None, *, cmap: str = "gray", figsize: Any = None, nrows: int | None = None, ncols: int | None = None, stretch: bool = True, pmin: float = 2, pmax: float = 98, colorbar: bool = False, colorbar_label: str | None = None, title: str | None = None, save_path: str | None = None, dpi: int = 300, **kwargs: Any) -> DataFrame:
    """Display values of bands on a decimated grid, in pixel coordinates."""
    bands = [bands] if isinstance(bands, (int, str)) else bands
    small = _decimated(ds, figsize, dpi)
    auto_grid(len(bands or ds.meta.band_names), nrows, ncols)
    return stretched(small, bands, pmin, pmax) if stretch else small.df


@raster_viz
def plot_raster(ds: Raster, bands: Any = None, *, cmap: str = "gray", figsize: Any = None, nrows: int | None = None, ncols: int | None = None, stretch: bool = True, pmin: float = 2, pmax: float = 98, colorbar: bool = False, colorbar_label: str | None = None, title: str | None = None, save_path: str | None = None, dpi: int = 300, **kwargs: Any) -> DataFrame:
    """The same with map coordinates x, y of pixel centres."""
    small = _decimated(ds, figsize, dpi)
    t = small.meta.transform
    shown = plot_band_array(small, bands, figsize=figsize, nrows=nrows, ncols=ncols, stretch=stretch, pmin=pmin, pmax=pmax, dpi=dpi)
    c, r = F.col("col") + 0.5, F.col("row") + 0.5
    return shown.withColumn("x", c * t.a + r * t.b + t.c).withColumn("y", c * t.d + r * t.e + t.f)


@raster_viz
def plot_histogram(ds: Raster, bands: Any = None, *, bins: int = 256, figsize: Any = None, nrows: int | None = None, ncols: int | None = None, log: bool = False, title: str | None = None, save_path: str | None = None, dpi: int = 300, **kwargs: Any) -> DataFrame:
    """band, bin, low, high, n over all pixels."""
    bands = [bands] if isinstance(bands, (int, str)) else bands
    which = [ds.meta.band_index(b) for b in bands] if bands else range(1, ds.meta.count + 1)
    out = None
    for i in which:
        h = histogram(ds, i, bins).select(F.lit(i).alias("band"), "bin", "low", "high", "n")
        out = h if out is None else out.unionByName(h)
    return out


@raster_viz
def plot_raster_with_histogram(ds: Raster, bands: Any = None, *, cmap: str = "gray", figsize: Any = (10, 5), bins: int = 256, pmin: float = 2, pmax: float = 98, stretch: bool = False, colorbar: bool = False, colorbar_label: str | None = None, save_path: str | None = None, dpi: int = 300, title: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Display values with map coordinates, and the histogram of the same decimated pixels."""
    small = _decimated(ds, figsize, dpi)
    return plot_raster(small, bands, figsize=figsize, stretch=stretch, pmin=pmin, pmax=pmax, dpi=dpi), plot_histogram(small, bands, bins=bins)


@raster_viz
def composite(ds: Raster, bands: Any, *, stretch: bool = True, pmin: float = 2, pmax: float = 98) -> DataFrame:
    """row, col, red, green, blue, alpha of every pixel, none decimated; nodata in any channel is transparent."""
    if not isinstance(bands, (list, tuple)) or len(bands) != 3:
        raise ValidationError("a composite has three bands")
    which = [ds.meta.band_index(b) for b in bands]
    if stretch:
        shown = stretched(ds, which, pmin, pmax)
    else:
        shown = ds._base.select("row", "col", *[ds.column(i).cast("double").alias(f"d{k}") for k, i in enumerate(which, 1)])
    ok = F.col("d1").isNotNull() & F.col("d2").isNotNull() & F.col("d3").isNotNull()
    return shown.select("row", "col", F.col("d1").alias("red"), F.col("d2").alias("green"), F.col("d3").alias("blue"), F.when(ok, 1.0).otherwise(0.0).alias("alpha"))


@raster_viz
def plot_composite(ds: Raster, bands: Any, *, stretch: bool = True, figsize: Any = (8, 8), pmin: float = 2, pmax: float = 98, title: str | None = None, save_path: str | None = None, dpi: int = 300) -> DataFrame:
    """The composite of a decimated grid."""
    return composite(_decimated(ds, figsize, dpi), bands, stretch=stretch, pmin=pmin, pmax=pmax)
