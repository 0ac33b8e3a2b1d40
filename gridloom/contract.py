"""The nodata and pixel type contract.

Inside the engine a nodata pixel is NULL: it stays NULL through arithmetic and drops out of aggregates. NaN and integer
sentinels are applied only where pixels leave the engine. Results are computed in NumPy's promoted type; doubles narrow to
single precision; integers wrap.
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import ValidationError
from .meta import STORAGE


def storage(dtype: str) -> str:
    return STORAGE[dtype]


def is_integer(dtype: str) -> bool:
    return np.issubdtype(np.dtype(dtype), np.integer)


def decode(col: Column, nodata: float | int | None, dtype: str) -> Column:
    """Stored values to values with NULL for nodata."""
    if nodata is None:
        return col
    if isinstance(nodata, float) and math.isnan(nodata):
        return F.nanvl(col, F.lit(None).cast(storage(dtype)))
    return F.when(col == F.lit(nodata).cast(storage(dtype)), F.lit(None)).otherwise(col)


def encode(col: Column, nodata: float | int | None, dtype: str) -> Column:
    """Values with NULL to stored values."""
    if nodata is None:
        return col
    return F.coalesce(col, F.lit(nodata).cast(storage(dtype)))


def result_nodata(dtype: str, *declared: float | int | None) -> float | int | None:
    """nodata of a result: NaN for floats, else the first operand's sentinel; None if no operand declares one."""
    known = [n for n in declared if n is not None]
    if not known:
        return None
    if not is_integer(dtype):
        return float("nan")
    info = np.iinfo(dtype)
    fitting = [n for n in known if not math.isnan(float(n)) and info.min <= n <= info.max and n == int(n)]
    return int(fitting[0]) if fitting else int(info.min if info.min < 0 else info.max)


def settle(col: Column, dtype: str, nodata: float | int | None) -> Column:
    """A result in its storage type; where NaN means nodata, stray NaN become NULL."""
    col = col.cast(storage(dtype))
    if isinstance(nodata, float) and math.isnan(nodata):
        col = F.nanvl(col, F.lit(None).cast(storage(dtype)))
    return col


def promoted(dtype: str, other: Any) -> str:
    """The type in which dtype and another dtype or a Python scalar are computed. Integers outside dtype promote it."""
    if isinstance(other, str):
        return np.result_type(np.dtype(dtype), np.dtype(other)).name
    if isinstance(other, (bool, np.bool_)):
        raise ValidationError("an operand is a raster or a number")
    if isinstance(other, (int, np.integer)):
        if is_integer(dtype):
            info = np.iinfo(dtype)
            if not info.min <= int(other) <= info.max:
                return np.result_type(np.dtype(dtype), np.min_scalar_type(int(other))).name
        return np.result_type(np.dtype(dtype), 1).name
    if isinstance(other, (float, np.floating)):
        return np.result_type(np.dtype(dtype), 1.0).name
    raise ValidationError(f"an operand is a raster or a number, not {type(other).__name__}")


def narrowed(dtype: str) -> str:
    return "float32" if np.issubdtype(np.dtype(dtype), np.floating) else dtype


def wrap(col: Column, dtype: str) -> Column:
    """An integer column, wide enough for the exact result, wrapped to dtype as fixed-width arithmetic does."""
    bits = np.iinfo(dtype).bits
    kind = "decimal(38,0)" if bits == 64 else "bigint"
    half, full = F.lit(2 ** (bits - 1)).cast(kind), F.lit(2**bits).cast("decimal(38,0)" if bits == 64 else "bigint")
    if dtype.startswith("u"):
        return F.pmod(col.cast(kind), full).cast(storage(dtype))
    return (F.pmod(col.cast(kind) + half, full) - half).cast(storage(dtype))


def arithmetic(op, left: Column, right: Column, dtype: str) -> Column:
    """op on two columns as NumPy computes it in ``dtype``: exact then rounded once, or wrapped."""
    if is_integer(dtype):
        kind = "decimal(38,0)" if np.iinfo(dtype).bits == 64 else "bigint"
        return wrap(op(left.cast(kind), right.cast(kind)), dtype)
    first = "float" if dtype == "float32" else "double"
    return op(left.cast(first).cast("double"), right.cast(first).cast("double")).cast(first)


def step(expr: Column) -> Column:
    """One single-precision step of a formula."""
    return expr.cast("float")
