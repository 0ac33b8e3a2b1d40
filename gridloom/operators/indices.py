"""Spectral indices: one single-precision band, computed step by step in single precision."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import contract
from ..contract import step
from ..errors import ValidationError
from ..raster import Raster, raster_op
from .algebra import aligned, together


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d, 0 where d is 0, NULL where either is."""
    return F.when(n.isNull() | d.isNull(), F.lit(None)).when(d == 0, F.lit(0.0)).otherwise(n.cast("double") / F.when(d != 0, d).cast("double")).cast("float")


def _bands(ds: Raster, specs: dict[str, Any], auto_align: bool, method: Any) -> tuple[Any, list[Column], list[Any]]:
    """(base, one single-precision expression per spec, nodata per spec); a spec is a raster, an index or a name."""
    rasters = []
    for name, spec in specs.items():
        if isinstance(spec, Raster):
            rasters.append(aligned(ds, spec, auto_align, method).band(1))
        elif isinstance(spec, (int, str)) and not isinstance(spec, bool):
            rasters.append(ds.band(spec))
        else:
            raise ValidationError(f"{name} is a raster, a band index or a band name")
    base, exprs = together(*rasters)
    return base, [e[0].cast("float") for e in exprs], [r.meta.nodata for r in rasters]


def _index(ds: Raster, specs: dict[str, Any], formula: Callable[..., Column], name: str | None, auto_align: bool, method: Any) -> Raster:
    base, bands, nodata = _bands(ds, specs, auto_align, method)
    out = contract.result_nodata("float32", *nodata)
    expr = contract.settle(formula(*bands), "float32", out)
    names = (name,) if name is not None else ()
    if base is ds._base:
        return ds.derived([expr], dtype="float32", nodata=out, band_names=names)
    return ds.replaced(base.select("row", "col", expr.alias("b1")), dtype="float32", nodata=out, count=1, band_names=names)


def _normal(a: Column, b: Column) -> Column:
    return safe_ratio(step(a - b), step(a + b))


@raster_op(propagate_band_names=False)
def normalized_difference(ds: Raster, other: Raster, *, auto_align: bool = True, method: Any = "bilinear", name: str | None = None) -> Raster:
    """(ds - other) / (ds + other), band by band."""
    if not isinstance(other, Raster):
        raise ValidationError("the other operand is a raster")
    if name is not None and ds.meta.count > 1:
        raise ValidationError("a name fits a single-band result only")
    other = aligned(ds, other, auto_align, method)
    if other.meta.count not in (1, ds.meta.count):
        raise ValidationError(f"{other.meta.count} bands don't fit {ds.meta.count}")
    base, (own, theirs) = together(ds, other)
    theirs = theirs * len(own) if len(theirs) == 1 else theirs
    out = contract.result_nodata("float32", ds.meta.nodata, other.meta.nodata)
    exprs = [contract.settle(_normal(a.cast("float"), b.cast("float")), "float32", out) for a, b in zip(own, theirs, strict=True)]
    names = (name,) if name is not None else ()
    if base is ds._base:
        return ds.derived(exprs, dtype="float32", nodata=out, band_names=names)
    return ds.replaced(base.select("row", "col", *[e.alias(f"b{i}") for i, e in enumerate(exprs, 1)]), dtype="float32", nodata=out, band_names=names)


@raster_op(propagate_band_names=False)
def ndvi(ds: Raster, red: Any, *, nir: Any = 1, auto_align: bool = True, method: Any = "bilinear", name: str | None = None) -> Raster:
    """Vegetation: (nir - red) / (nir + red)."""
    return _index(ds, {"nir": nir, "red": red}, _normal, name, auto_align, method)


@raster_op(propagate_band_names=False)
def ndwi(ds: Raster, nir: Any, *, green: Any = 1, auto_align: bool = True, method: Any = "bilinear", name: str | None = None) -> Raster:
    """Water: (green - nir) / (green + nir)."""
    return _index(ds, {"green": green, "nir": nir}, _normal, name, auto_align, method)


@raster_op(propagate_band_names=False)
def ndmi(ds: Raster, swir: Any, *, nir: Any = 1, auto_align: bool = True, method: Any = "bilinear", name: str | None = None) -> Raster:
    """Moisture: (nir - swir) / (nir + swir)."""
    return _index(ds, {"nir": nir, "swir": swir}, _normal, name, auto_align, method)


@raster_op(propagate_band_names=False)
def ndbi(ds: Raster, nir: Any, *, swir: Any = 1, auto_align: bool = True, method: Any = "bilinear", name: str | None = None) -> Raster:
    """Built-up land: (swir - nir) / (swir + nir)."""
    return _index(ds, {"swir": swir, "nir": nir}, _normal, name, auto_align, method)


@raster_op(propagate_band_names=False)
def evi(ds: Raster, red: Any, blue: Any, *, nir: Any = 1, auto_align: bool = True, method: Any = "bilinear", name: str | None = None) -> Raster:
    """Enhanced vegetation: 2.5 (nir - red) / (nir + 6 red - 7.5 blue + 1)."""

    def formula(n: Column, r: Column, b: Column) -> Column:
        f = lambda v: F.lit(v).cast("float")
        below = step(step(step(n + step(f(6.0) * r)) - step(f(7.5) * b)) + f(1.0))
        return safe_ratio(step(f(2.5) * step(n - r)), below)

    return _index(ds, {"nir": nir, "red": red, "blue": blue}, formula, name, auto_align, method)


@raster_op(propagate_band_names=False)
def savi(ds: Raster, red: Any, *, nir: Any = 1, soil_factor: float = 0.5, auto_align: bool = True, method: Any = "bilinear", name: str | None = None) -> Raster:
    """Soil-adjusted vegetation: (1 + L)(nir - red) / (nir + red + L)."""

    def formula(n: Column, r: Column) -> Column:
        f = lambda v: F.lit(float(v)).cast("float")
        return safe_ratio(step(f(1 + soil_factor) * step(n - r)), step(step(n + r) + f(soil_factor)))

    return _index(ds, {"nir": nir, "red": red}, formula, name, auto_align, method)
