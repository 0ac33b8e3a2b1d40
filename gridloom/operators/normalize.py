"""Normalisation: one aggregate over all bands together, broadcast as a single row, then a projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import contract
from ..errors import ValidationError
from ..functions.quantiles import percentiles
from ..raster import Raster, raster_op
from .stats import valid


def _pooled(ds: Raster):
    """One column v: the valid values of all bands."""
    values = F.array(*[valid(e, ds.meta.dtype).cast("double") for e in ds._exprs])
    return ds._base.select(F.explode(values).alias("v")).where(F.col("v").isNotNull())


def _with(ds: Raster, one_row, formula) -> Raster:
    nodata = contract.result_nodata("float32", ds.meta.nodata)
    joined = ds._base.crossJoin(F.broadcast(one_row))
    exprs = [contract.settle(F.when(e.isNotNull(), formula(e.cast("double"))), "float32", nodata).alias(f"b{i}") for i, e in enumerate(ds._exprs, 1)]
    return ds.replaced(joined.select("row", "col", *exprs), dtype="float32", nodata=nodata)


def _over(n: Column, d: Column) -> Column:
    """n / d with IEEE results for a denominator of 0."""
    zero = F.when(n > 0, F.lit(float("inf"))).when(n < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(d == 0, zero).otherwise(n / F.when(d != 0, d))


@raster_op
def standardize(ds: Raster) -> Raster:
    """(x - mean) / population standard deviation."""
    row = _pooled(ds).agg(F.avg("v").alias("__mean"), F.stddev_pop("v").alias("__std"))
    return _with(ds, row, lambda e: _over(e - F.col("__mean"), F.col("__std")))


@raster_op
def normalize_min_max(ds: Raster, *, new_min: float = 0, new_max: float = 1) -> Raster:
    """The values' range onto [new_min, new_max]; a constant raster gives NaN."""
    row = _pooled(ds).agg(F.min("v").alias("__low"), F.max("v").alias("__high"))
    return _with(ds, row, lambda e: _over(e - F.col("__low"), F.col("__high") - F.col("__low")) * F.lit(float(new_max) - float(new_min)) + F.lit(float(new_min)))


@raster_op
def normalize_percentile(ds: Raster, *, lower_percentile: float = 2, upper_percentile: float = 98) -> Raster:
    """The range between two percentiles onto [0, 1], values beyond held at the ends."""
    if not (0 <= lower_percentile <= 100 and 0 <= upper_percentile <= 100):
        raise ValidationError("percentiles lie in [0, 100]")
    pooled = _pooled(ds).select(F.lit(1).alias("g"), F.col("v").cast("double").alias("v"))
    row = percentiles(pooled, [lower_percentile / 100, upper_percentile / 100], ds.meta.height * ds.meta.width * ds.meta.count).select(F.col("p")[0].alias("__low"), F.col("p")[1].alias("__high"))

    def formula(e: Column) -> Column:
        x = _over(e - F.col("__low"), F.col("__high") - F.col("__low"))
        return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))

    return _with(ds, row, formula)
