"""Pixel algebra: projections, or one equi-join on (row, col) for rasters of different bases."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import contract
from ..errors import AlignmentError, CRSMismatchError, ValidationError
from ..raster import Raster, raster_op

log = logging.getLogger("gridloom")


def aligned(ds: Raster, other: Raster, auto_align: bool, method: Any) -> Raster:
    """``other`` on ds's grid: itself, or resampled onto it by georeference."""
    if other.meta.crs != ds.meta.crs:
        raise CRSMismatchError(f"rasters lie in {ds.meta.crs} and {other.meta.crs}")
    if ds.meta.same_grid(other.meta):
        return other
    if not auto_align:
        raise AlignmentError(f"grids differ: {ds.meta.shape} and {other.meta.shape}; auto_align is off")
    from .resample import align_to

    log.info("aligning a %s raster to a %s grid by %s", other.meta.shape, ds.meta.shape, method)
    return align_to(other, ds, method)


def together(*rasters: Raster) -> tuple[Any, list[list[Column]]]:
    """One base that holds all rasters' bands, and each raster's expressions over it."""
    groups: list[tuple[Any, list[int]]] = []
    for i, r in enumerate(rasters):
        for base, members in groups:
            if base is r._base:
                members.append(i)
                break
        else:
            groups.append((r._base, [i]))
    if len(groups) == 1:
        return rasters[0]._base, [list(r._exprs) for r in rasters]
    exprs: list[list[Column]] = [[] for _ in rasters]
    joined = None
    for g, (base, members) in enumerate(groups):
        columns = []
        for i in members:
            names = [f"__{g}_{i}_{k}" for k in range(len(rasters[i]._exprs))]
            columns += [e.alias(n) for e, n in zip(rasters[i]._exprs, names, strict=True)]
            exprs[i] = [F.col(n) for n in names]
        part = base.select("row", "col", *columns)
        joined = part if joined is None else joined.join(part, ["row", "col"])
    return joined, exprs


def _operand(ds: Raster, other: Any, auto_align: bool, method: Any) -> tuple[Any, list[Column], list[Column], str, Any]:
    """(base, ds's bands, the operand's bands, computing type, the operand's nodata)."""
    if isinstance(other, Raster):
        other = aligned(ds, other, auto_align, method)
        if other.meta.count not in (1, ds.meta.count):
            raise ValidationError(f"{other.meta.count} bands don't fit {ds.meta.count}")
        base, (own, theirs) = together(ds, other)
        theirs = theirs * (ds.meta.count // len(theirs)) if len(theirs) == 1 else theirs
        return base, own, theirs, contract.promoted(ds.meta.dtype, other.meta.dtype), other.meta.nodata
    kind = contract.promoted(ds.meta.dtype, other)
    return ds._base, list(ds._exprs), [F.lit(other)] * ds.meta.count, kind, None


def _finish(ds: Raster, base: Any, exprs: list[Column], dtype: str, nodata: Any) -> Raster:
    exprs = [contract.settle(e, dtype, nodata) for e in exprs]
    if base is ds._base:
        return ds.derived(exprs, dtype=dtype, nodata=nodata)
    named = base.select("row", "col", *[e.alias(f"b{i}") for i, e in enumerate(exprs, 1)])
    return ds.replaced(named, dtype=dtype, nodata=nodata)


def _binary(ds: Raster, other: Any, op: Callable, auto_align: bool, method: Any) -> Raster:
    base, own, theirs, kind, nodata = _operand(ds, other, auto_align, method)
    out = contract.narrowed(kind)
    return _finish(ds, base, [contract.arithmetic(op, a, b, kind) for a, b in zip(own, theirs, strict=True)], out, contract.result_nodata(out, ds.meta.nodata, nodata))


@raster_op
def add(ds: Raster, other: Any, *, auto_align: bool = True, method: Any = "bilinear") -> Raster:
    """ds + other; integers wrap."""
    return _binary(ds, other, lambda a, b: a + b, auto_align, method)


@raster_op
def subtract(ds: Raster, other: Any, *, auto_align: bool = True, method: Any = "bilinear") -> Raster:
    """ds - other; integers wrap."""
    return _binary(ds, other, lambda a, b: a - b, auto_align, method)


@raster_op
def multiply(ds: Raster, other: Any, *, auto_align: bool = True, method: Any = "bilinear") -> Raster:
    """ds * other; integers wrap."""
    return _binary(ds, other, lambda a, b: a * b, auto_align, method)


@raster_op
def reverse_subtract(ds: Raster, other: Any) -> Raster:
    """other - ds, in the promoted type."""
    return _binary(ds, other, lambda a, b: b - a, True, "bilinear")


def quotient(n: Column, d: Column, safe: bool, kind: str = "float32") -> Column:
    """n / d in single precision; a denominator of 0 gives 0 if ``safe``, else what IEEE division gives. NULL stays NULL."""
    first = "float" if kind == "float32" else "double"
    n, d = n.cast(first).cast("double"), d.cast(first).cast("double")
    by_zero = F.lit(0.0) if safe else F.when(n > 0, F.lit(math.inf)).when(n < 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))
    if not safe:
        by_zero = F.when(F.isnan(n), F.lit(math.nan)).otherwise(by_zero)
    return F.when(n.isNull() | d.isNull(), F.lit(None)).when(d == 0, by_zero).otherwise(n / F.when(d != 0, d)).cast("float")


@raster_op
def divide(ds: Raster, other: Any, *, auto_align: bool = True, method: Any = "bilinear", safe: bool = True) -> Raster:
    """ds / other, single precision. ``safe``: zero denominators give 0, a zero scalar an all-zero raster."""
    base, own, theirs, kind, nodata = _operand(ds, other, auto_align, method)
    kind = "float32" if kind in ("float32", "int8", "uint8", "int16", "uint16") else "float64"
    return _finish(ds, base, [quotient(a, b, safe, kind) for a, b in zip(own, theirs, strict=True)], "float32", contract.result_nodata("float32", ds.meta.nodata, nodata))


@raster_op
def reverse_divide(ds: Raster, other: Any) -> Raster:
    """other / ds as division defines it: zero pixels give 0."""
    kind = "float32" if ds.meta.dtype in ("float32", "int8", "uint8", "int16", "uint16") else "float64"
    return _finish(ds, ds._base, [quotient(F.lit(other), e, True, kind) for e in ds._exprs], "float32", contract.result_nodata("float32", ds.meta.nodata))


@raster_op
def power(ds: Raster, exponent: float) -> Raster:
    """ds ** exponent (a number). Whole non-negative powers of integers are exact and wrap."""
    if isinstance(exponent, (bool, np.bool_)) or not isinstance(exponent, (int, float, np.integer, np.floating)):
        raise ValidationError("the exponent is a number")
    kind = contract.promoted(ds.meta.dtype, exponent)
    if contract.is_integer(kind) and exponent < 0:
        raise ValidationError("integers can't be raised to negative integer powers")
    if contract.is_integer(kind) and exponent <= 64:
        wide = "decimal(38,0)" if np.iinfo(kind).bits == 64 else "bigint"

        def whole(e: Column) -> Column:
            # modular powers by repeated multiplication; the fold keeps the expression small
            one = F.when(e.isNotNull(), F.lit(1).cast(contract.storage(kind)))
            return F.aggregate(F.array_repeat(e.cast(contract.storage(kind)), int(exponent)), one, lambda acc, x: contract.wrap(acc.cast(wide) * x.cast(wide), kind))

        exprs = [whole(e) for e in ds._exprs]
    else:
        first = "float" if kind == "float32" else "double"
        exprs = [F.pow(e.cast(first).cast("double"), F.lit(float(exponent))).cast("float") for e in ds._exprs]
    out = contract.narrowed(kind)
    return _finish(ds, ds._base, exprs, out, contract.result_nodata(out, ds.meta.nodata))


def _float_op(ds: Raster, f: Callable[[Column], Column]) -> Raster:
    nodata = contract.result_nodata("float32", ds.meta.nodata)
    return _finish(ds, ds._base, [F.when(e.isNotNull(), f(e.cast("double"))).cast("float") for e in ds._exprs], "float32", nodata)


@raster_op
def sqrt(ds: Raster) -> Raster:
    """Square root; negative values count as 0."""
    return _float_op(ds, lambda e: F.when(F.isnan(e), e).otherwise(F.sqrt(F.greatest(e, F.lit(0.0)))))


def log_(ds: Raster, base: float = math.e) -> Raster:
    """Logarithm; values below 1e-10 count as that."""
    if not base > 0 or base == 1:
        raise ValidationError("the base of a logarithm is positive and not 1")
    return _float_op(ds, lambda e: F.when(F.isnan(e), e).otherwise(F.ln(F.greatest(e, F.lit(1e-10))) / F.lit(math.log(base))))


@raster_op
def absolute(ds: Raster) -> Raster:
    """Absolute values; the least integer stays, as in fixed-width arithmetic."""
    kind = ds.meta.dtype
    if contract.is_integer(kind):
        exprs = [contract.wrap(F.abs(e.cast("decimal(38,0)" if np.iinfo(kind).bits == 64 else "bigint")), kind) for e in ds._exprs]
    else:
        exprs = [F.abs(e) for e in ds._exprs]
    out = contract.narrowed(kind)
    return _finish(ds, ds._base, exprs, out, contract.result_nodata(out, ds.meta.nodata))


# ``log`` is the method's name; the module's own ``log`` is its logger
log_.__name__ = "log"
raster_op(log_)
