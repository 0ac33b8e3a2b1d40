"""What users of rasters compute next: zones, classes, change, thresholds, terrain, composites over time."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.quantiles import percentiles
from ..raster import Raster, raster_op
from . import tiles
from .algebra import together
from .stats import valid


def pixel_area(ds: Raster) -> float:
    t = ds.meta.transform
    return abs(t.a * t.e - t.b * t.d)


def paired(ds: Raster, other: Raster, band: Any = 1, other_band: Any = 1) -> DataFrame:
    """row, col, a, b of two bands on one grid."""
    base, (own, theirs) = together(ds.band(band), other.band(other_band))
    return base.select("row", "col", valid(own[0], ds.meta.dtype).alias("a"), valid(theirs[0], other.meta.dtype).alias("b"))


def class_shares(ds: Raster, band: Any = 1) -> DataFrame:
    """class, n, share, area: valid pixels of each value."""
    counts = ds._base.select(valid(ds.column(band), ds.meta.dtype).alias("class")).where(F.col("class").isNotNull()).groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("class", "n", (F.col("n") / F.col("total")).alias("share"), (F.col("n") * pixel_area(ds)).alias("area"))


def zonal(ds: Raster, zones: Raster, band: Any = 1, zone_band: Any = 1) -> DataFrame:
    """zone, n, n_valid, minimum, maximum, mean, std of a band within each zone."""
    return (
        paired(ds, zones, band, zone_band)
        .where(F.col("b").isNotNull())
        .groupBy(F.col("b").alias("zone"))
        .agg(F.count(F.lit(1)).alias("n"), F.count("a").alias("n_valid"), F.min("a").cast("double").alias("minimum"), F.max("a").cast("double").alias("maximum"), F.avg(F.col("a").cast("double")).alias("mean"), F.stddev_pop(F.col("a").cast("double")).alias("std"))
    )


def zonal_rollup(ds: Raster, zones: Raster, parents: DataFrame, band: Any = 1) -> DataFrame:
    """parent, zone, n_valid, mean with subtotals (NULL zone, NULL parent). parents: (zone, parent)."""
    joined = paired(ds, zones, band).select(F.col("a"), F.col("b").alias("zone")).where(F.col("zone").isNotNull()).join(parents, "zone")
    return joined.rollup("parent", "zone").agg(F.count("a").alias("n_valid"), F.avg(F.col("a").cast("double")).alias("mean"))


def change_matrix(before: Raster, after: Raster, band: Any = 1, other_band: Any = 1) -> DataFrame:
    """from_class, to_class, n, area of pixels valid in both."""
    pairs = paired(before, after, band, other_band).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    return pairs.groupBy(F.col("a").alias("from_class"), F.col("b").alias("to_class")).agg(F.count(F.lit(1)).alias("n")).withColumn("area", F.col("n") * pixel_area(before))


def threshold_sweep(ds: Raster, thresholds: Sequence[float], band: Any = 1) -> DataFrame:
    """threshold, n, share: valid pixels above each threshold, all in one pass."""
    v = valid(ds.column(band), ds.meta.dtype).cast("double")
    counts = [F.struct(F.lit(float(t)).alias("threshold"), F.count(F.when(v > float(t), 1)).alias("n"), F.count(v).alias("total")) for t in thresholds]
    rows = ds._base.agg(F.array(*counts).alias("a")).select(F.explode("a").alias("z")).select("z.*")
    return rows.select("threshold", "n", F.when(F.col("total") > 0, F.col("n") / F.col("total")).alias("share"))


def binned(ds: Raster, other: Raster, edges: Sequence[float], band: Any = 1, other_band: Any = 1, least: int = 0) -> DataFrame:
    """bin, n, mean of ``other`` where ds's band lies in [edges[bin], edges[bin + 1]); bins of more than ``least`` pixels."""
    if list(edges) != sorted(edges) or len(edges) < 2:
        raise ValidationError("edges ascend")
    place: Column = F.lit(None)
    for k in range(len(edges) - 1):
        place = F.when((F.col("a") >= float(edges[k])) & (F.col("a") < float(edges[k + 1])), F.lit(k)).otherwise(place)
    pairs = paired(ds, other, band, other_band).where(F.col("a").isNotNull() & F.col("b").isNotNull()).withColumn("bin", place.cast("int")).where(F.col("bin").isNotNull())
    return pairs.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("b").cast("double")).alias("mean")).where(F.col("n") > least)


def correlation(ds: Raster, other: Raster, band: Any = 1, other_band: Any = 1) -> DataFrame:
    """n, r over pixels valid in both."""
    pairs = paired(ds, other, band, other_band).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.corr(F.col("a").cast("double"), F.col("b").cast("double")).alias("r"))


def hypsometric(ds: Raster, points: int = 101, band: Any = 1) -> DataFrame:
    """share, value: the value that each share of pixels lies at or below."""
    v = valid(ds.column(band), ds.meta.dtype).cast("double")
    at = [k / (points - 1) for k in range(points)]
    row = percentiles(ds._base.select(F.lit(1).alias("g"), v.alias("v")), at, ds.meta.height * ds.meta.width)
    return row.select(F.posexplode("p").alias("k", "value")).select((F.col("k") / (points - 1)).alias("share"), "value")


def gradients(ds: Raster, band: Any = 1) -> DataFrame:
    """row, col, v, dy, dx: central differences by pixel size, one-sided at the edges; NULL beside nodata.

    Computed on tiles; only the strips along their edges are shuffled, where tiles are stored.
    """
    t, m = ds.meta.transform, ds.meta
    own = ds.derived([valid(ds.column(band), m.dtype).cast("double")], dtype="float64")
    blocks = tiles.surrounding(own.tiles(), m.height, m.width, 1, 1, tiles.differences(t.e, t.a), ["double"] * 3)
    return tiles.pixels_of(blocks, 3).toDF("row", "col", "v", "dy", "dx")


@raster_op(propagate_band_names=False)
def slope(ds: Raster, band: Any = 1) -> Raster:
    """Steepness in degrees."""
    g = gradients(ds, band)
    df = g.select("row", "col", F.degrees(F.atan(F.hypot("dx", "dy"))).cast("float").alias("b1"))
    return ds.replaced(df, count=1, dtype="float32", nodata=float("nan"))


@raster_op(propagate_band_names=False)
def aspect(ds: Raster, band: Any = 1) -> Raster:
    """The direction that a slope faces, in degrees clockwise from north."""
    g = gradients(ds, band)
    df = g.select("row", "col", F.pmod(F.degrees(F.atan2(-F.col("dx"), F.col("dy"))), F.lit(360.0)).cast("float").alias("b1"))
    return ds.replaced(df, count=1, dtype="float32", nodata=float("nan"))


@raster_op(propagate_band_names=False)
def hillshade(ds: Raster, band: Any = 1, *, azimuth: float = 315, altitude: float = 45) -> Raster:
    """Illumination in [0, 1] by a light at ``azimuth`` and ``altitude`` degrees."""
    g = gradients(ds, band)
    steep, facing = F.atan(F.hypot("dx", "dy")), F.atan2(-F.col("dx"), F.col("dy"))
    zenith, az = math.radians(90 - altitude), math.radians(azimuth)
    light = F.lit(math.cos(zenith)) * F.cos(steep) + F.lit(math.sin(zenith)) * F.sin(steep) * F.cos(F.lit(az) - facing)
    df = g.select("row", "col", F.when(light.isNotNull(), F.greatest(light, F.lit(0.0))).cast("float").alias("b1"))
    return ds.replaced(df, count=1, dtype="float32", nodata=float("nan"))


@raster_op
def focal_mean(ds: Raster, radius: int = 1) -> Raster:
    """The mean of valid pixels in a square around each pixel, computed on tiles with halos."""
    m = ds.meta
    if not 0 < radius <= tiles.TILE // 2:
        raise ValidationError(f"a radius lies between 1 and {tiles.TILE // 2}")
    blocks = tiles.surrounding(ds.tiles(["double"] * m.count), m.height, m.width, m.count, radius, tiles.box_means(radius), ["float"] * m.count)
    return ds.replaced(tiles.pixels_of(blocks, m.count), dtype="float32", nodata=None if m.nodata is None else float("nan"))


def time_composite(scenes: Sequence[Raster], method: str = "median") -> Raster:
    """One raster of scenes of one grid: per pixel and band the median, mean, minimum, maximum or latest valid value."""
    if not scenes:
        raise ValidationError("at least one scene is needed")
    first = scenes[0]
    if any(not first.meta.same_grid(s.meta) or s.meta.count != first.meta.count for s in scenes):
        raise ValidationError("scenes share a grid and bands")
    if method == "latest" and any(s.meta.timestamp is None for s in scenes):
        raise ValidationError("the latest value needs timestamps")
    names = [f"b{i}" for i in range(1, first.meta.count + 1)]
    union = functools.reduce(DataFrame.unionByName, [s.df.withColumn("ts", F.lit(s.meta.timestamp).cast("timestamp")) for s in scenes])
    pick = composite_column(method)
    df = union.groupBy("row", "col").agg(*[pick(b).cast("float").alias(b) for b in names])
    nodata = None if all(s.meta.nodata is None for s in scenes) else float("nan")
    return first.replaced(df, dtype="float32", nodata=nodata, band_names=first.meta.band_names)


def composite_column(method: str):
    known = {
        "median": lambda b: F.percentile(F.col(b).cast("double"), 0.5),
        "mean": lambda b: F.avg(F.col(b).cast("double")),
        "min": lambda b: F.min(b),
        "max": lambda b: F.max(b),
        "latest": lambda b: F.max_by(b, F.when(F.col(b).isNotNull(), F.col("ts"))),
    }
    if method not in known:
        raise ValidationError(f"method is one of {sorted(known)}")
    return known[method]


def composite_observations(table: DataFrame, method: str, bands: Sequence[str]) -> DataFrame:
    """row, col and one value per band of a table of observations (row, col, ts, bands)."""
    pick = composite_column(method)
    return table.groupBy("row", "col").agg(*[pick(b).alias(b) for b in bands])
