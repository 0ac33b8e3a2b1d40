"""Resampling between grids with parallel axes.

* Nearest neighbour: each source pixel knows, from arithmetic on its row and column alone, its target pixels; no shuffle.
* Weighted methods: on tiles with halos (``tiles``), rows and columns weighted one after the other, as two matrix products a
  block. A block makes the target pixels whose centres fall into its core, so each is made once and whole.
* Order statistics and modes, and scales whose reach is more than a quarter of a tile: an explode and one aggregation with
  partial sums, which combine before the shuffle.
"""

from __future__ import annotations

import enum
import math
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contract
from ..errors import AlignmentError, BackendError, CRSMismatchError, ValidationError
from ..raster import Raster, raster_op
from . import tiles


class Resampling(enum.Enum):
    """Methods by name."""

    nearest = "nearest"
    bilinear = "bilinear"
    cubic = "cubic"
    cubic_spline = "cubic_spline"
    lanczos = "lanczos"
    average = "average"
    mode = "mode"
    max = "max"
    min = "min"
    med = "med"
    q1 = "q1"
    q3 = "q3"
    gauss = "gauss"
    sum = "sum"
    rms = "rms"


AREA = {"average", "mode", "max", "min", "med", "q1", "q3", "sum", "rms"}
#: Half the width of each kernel.
SUPPORT = {"bilinear": 1, "cubic": 2, "cubic_spline": 2, "lanczos": 3, "gauss": 2}
#: Methods that weigh rows and columns apart.
WEIGHTED = {*SUPPORT, "average", "sum", "rms"}


def normalize_resampling_method(method: Any) -> str:
    """A method's name, from a name in any case or an enum value."""
    name = method.name if isinstance(method, enum.Enum) else method
    if isinstance(name, str) and name.strip().casefold() in Resampling.__members__:
        return name.strip().casefold()
    raise ValidationError(f"unknown resampling method {method!r}; methods are {', '.join(Resampling.__members__)}")


def kernel(method: str, x: Column) -> Column:
    """A kernel's weight at distance x."""
    a = F.abs(x)
    if method == "bilinear":
        return F.greatest(F.lit(0.0), 1 - a)
    if method == "cubic":
        return F.when(a <= 1, (1.5 * a - 2.5) * a * a + 1).when(a < 2, ((-0.5 * a + 2.5) * a - 4) * a + 2).otherwise(F.lit(0.0))
    if method == "cubic_spline":
        return F.when(a <= 1, (0.5 * a - 1) * a * a + F.lit(2 / 3)).when(a < 2, F.pow(2 - a, F.lit(3.0)) / 6).otherwise(F.lit(0.0))
    if method == "gauss":  # a standard deviation of half a pixel
        return F.when(a <= 2, F.exp(-2 * a * a)).otherwise(F.lit(0.0))
    p = a * math.pi
    return F.when(a == 0, F.lit(1.0)).when(a < 3, 3 * F.sin(p) * F.sin(p / 3) / F.when(a > 0, p * p)).otherwise(F.lit(0.0))


def weights(method: str, x: np.ndarray) -> np.ndarray:
    """A kernel's weights at distances x, as ``kernel`` gives them."""
    a = np.abs(x)
    if method == "bilinear":
        return np.maximum(0.0, 1 - a)
    if method == "cubic":
        return np.where(a <= 1, (1.5 * a - 2.5) * a * a + 1, np.where(a < 2, ((-0.5 * a + 2.5) * a - 4) * a + 2, 0.0))
    if method == "cubic_spline":
        return np.where(a <= 1, (0.5 * a - 1) * a * a + 2 / 3, np.where(a < 2, (2 - a) ** 3 / 6, 0.0))
    if method == "gauss":
        return np.where(a <= 2, np.exp(-2 * a * a), 0.0)
    return np.where(a < 3, np.sinc(a) * np.sinc(a / 3), 0.0)


@dataclass(frozen=True)
class Axis:
    """One axis of a resampling: target pixel i has its centre at (i + 0.5) * den / num + shift in source pixels."""

    method: str
    num: float
    den: float
    shift: float
    source: int
    target: int

    @property
    def scale(self) -> float:
        return self.den / self.num

    @property
    def reach(self) -> float:
        """How far from its centre a target pixel reads."""
        return self.scale / 2 if self.method in AREA else SUPPORT[self.method] * max(1.0, self.scale)

    def made_by(self, lo: int, hi: int) -> tuple[int, int]:
        """The target pixels, from and to, that the source pixels from lo to hi make: those with their centre there.

        Those outside the source that still reach it are made by its first and last pixels.
        """

        def first(edge: float) -> int:  # the first centre at or behind the edge
            i = math.ceil((edge - self.shift) / self.scale - 0.5)
            while (i - 0.5) * self.scale + self.shift >= edge:
                i -= 1
            while (i + 0.5) * self.scale + self.shift < edge:
                i += 1
            return i

        start = first(lo) if lo else first(-self.reach)
        end = first(hi) if hi < self.source else first(self.source + self.reach)
        return min(max(start, 0), self.target), min(max(end, 0), self.target)

    def matrix(self, start: int, end: int, lo: int, n: int) -> np.ndarray:
        """Weights of the source pixels from lo on, n of them, in the target pixels from start to end."""
        i, j = np.arange(start, end)[:, None], np.arange(lo, lo + n)[None, :]
        if self.method in AREA:
            w = np.minimum((i + 1) * self.scale + self.shift, j + 1.0) - np.maximum(i * self.scale + self.shift, j + 0.0)
            return np.where(w > 1e-12, w, 0.0)
        wide = max(1.0, self.scale)
        w = weights(self.method, ((i + 0.5) * self.scale + self.shift - j - 0.5) / wide)
        return np.where(np.abs(w) > 1e-12, w, 0.0)


def in_blocks(rows: Axis, cols: Axis) -> bool:
    """Whether a resampling runs on tiles."""
    return rows.method in WEIGHTED and math.ceil(max(rows.reach, cols.reach)) + 1 <= tiles.TILE // 4


def rounded(value: np.ndarray, dtype: str) -> np.ndarray:
    """Values in their type, as ``finish`` makes them: halves go away from zero."""
    if not contract.is_integer(dtype):
        return value
    info, whole_part = np.iinfo(dtype), np.trunc(value)
    return np.clip(whole_part + np.sign(value) * (np.abs(value - whole_part) >= 0.5), float(info.min), float(info.max))


def weighing(rows: Axis, cols: Axis, dtype: str) -> tiles.Compute:
    """Target pixels of a block, by weighted sums over its rows and columns; invalid pixels drop out."""

    def compute(block: tiles.Block, core: tuple[int, int, int, int]) -> tiles.Block | None:
        r0, r1 = rows.made_by(*core[:2])
        c0, c1 = cols.made_by(*core[2:])
        if r0 >= r1 or c0 >= c1:
            return None
        down, across = rows.matrix(r0, r1, block.row0, block.shape[0]), cols.matrix(c0, c1, block.col0, block.shape[1]).T
        values, ok = block.values.astype(np.float64), block.valid
        odd = ok & ~np.isfinite(values)
        v = np.where(ok & ~odd, values, 0.0)
        total, weight = down @ (v * v if rows.method == "rms" else v) @ across, down @ ok.astype(np.float64) @ across
        good = np.abs(weight) > 1e-9
        if rows.method != "sum":
            total = total / np.where(good, weight, 1.0)
        if rows.method == "rms":
            total = np.sqrt(np.maximum(total, 0.0))
        if odd.any():
            total[(np.abs(down) @ odd.astype(np.float64) @ np.abs(across)) > 0] = np.nan
        return tiles.Block(r0, c0, rounded(total, dtype), good)

    return compute


def _axis(method: str, at: Column, num: float, den: float, shift: float, size: int) -> Column:
    """Target positions and weights of source index ``at``: array of (i, w).

    Target pixel i has its centre at (i + 0.5) * den / num + shift in source pixels.
    """
    edge = lambda x: (x - F.lit(float(shift))) * F.lit(float(num)) / F.lit(float(den))
    lo = lambda x: F.greatest(F.lit(0), F.ceil(x)).cast("int")
    hi = lambda x: F.least(F.lit(size - 1), x).cast("int")
    scale = den / num
    if method == "nearest":
        first, last = lo(edge(at) - 0.5), hi(F.ceil(edge(at + 1) - 0.5) - 1)
        weight = lambda i: F.lit(1.0)
    elif method in AREA:
        first, last = lo(F.floor(edge(at))), hi(F.ceil(edge(at + 1)) - 1)
        top = lambda i: F.least((i + 1) * F.lit(scale) + F.lit(float(shift)), at + 1.0)
        weight = lambda i: top(i) - F.greatest(i * F.lit(scale) + F.lit(float(shift)), at + 0.0)
    else:
        wide = max(1.0, scale)
        reach = SUPPORT[method] * wide
        first, last = lo(edge(at + 0.5 - reach) - 0.5), hi(F.floor(edge(at + 0.5 + reach) - 0.5))
        weight = lambda i: kernel(method, ((i + 0.5) * F.lit(scale) + F.lit(float(shift)) - at - 0.5) / F.lit(wide))
    each = F.transform(F.sequence(first, last), lambda i: F.struct(i.alias("i"), weight(i).alias("w")))
    each = each if method == "nearest" else F.filter(each, lambda s: F.abs(s["w"]) > 1e-12)
    return F.when(last >= first, each).otherwise(F.expr("cast(array() as array<struct<i:int,w:double>>)"))


def whole(spark: SparkSession, height: int, width: int) -> DataFrame:
    """row, col of every pixel of a grid."""
    n = spark.range(height * width)
    return n.select(F.expr(f"cast(id div {width} as int)").alias("row"), (F.col("id") % width).cast("int").alias("col"))


def finish(value: Column, dtype: str) -> Column:
    """A resampled value in its type: integers are rounded and held in range."""
    if contract.is_integer(dtype):
        info = np.iinfo(dtype)
        return F.when(value.isNotNull(), F.least(F.greatest(F.round(value), F.lit(float(info.min))), F.lit(float(info.max)))).cast(contract.storage(dtype))
    return value.cast(contract.storage(dtype))


def combined(parts: DataFrame, method: str, dtype: str, count: int) -> DataFrame:
    """row, col, b1 ...: contributions (row, col, w, b1 ...) of each target pixel put together; NULL values drop out."""
    names = [f"b{i}" for i in range(1, count + 1)]
    if method in ("max", "min"):
        pick = F.max if method == "max" else F.min
        return parts.groupBy("row", "col").agg(*[pick(n).alias(n) for n in names])
    if method in ("med", "q1", "q3"):
        p = {"med": 0.5, "q1": 0.25, "q3": 0.75}[method]
        return parts.groupBy("row", "col").agg(*[finish(F.percentile(F.col(n).cast("double"), p), dtype).alias(n) for n in names])
    if method == "mode":  # the value with most weight, the smallest among equals
        long = parts.select("row", "col", "w", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(n).alias("v")) for n in names])).alias("z")).select("row", "col", "w", "z.*")
        weighed = long.groupBy("row", "col", "n", "v").agg(F.sum("w").alias("w"))
        pick = lambda n: F.max_by("v", F.when((F.col("n") == n) & F.col("v").isNotNull(), F.struct(F.round("w", 9), -F.col("v"))))
        return weighed.groupBy("row", "col").agg(*[pick(n).alias(n) for n in names])
    sums = []
    for n in names:
        sums += [F.sum(F.when(F.col(n).isNotNull(), F.col("w") * F.col(n).cast("double"))).alias(f"{n}_s"), F.sum(F.when(F.col(n).isNotNull(), F.col("w"))).alias(f"{n}_w")]
    got = parts.groupBy("row", "col").agg(*sums)
    if method == "rms":
        got = parts.select("row", "col", "w", *[(F.col(n).cast("double") * F.col(n)).alias(n) for n in names]).groupBy("row", "col").agg(*sums)
    ratio = lambda n: F.when(F.abs(F.col(f"{n}_w")) > 1e-9, F.col(f"{n}_s") / F.when(F.abs(F.col(f"{n}_w")) > 1e-9, F.col(f"{n}_w")))
    value = {"sum": lambda n: F.col(f"{n}_s"), "rms": lambda n: F.sqrt(ratio(n))}.get(method, ratio)
    return got.select("row", "col", *[finish(value(n), dtype).alias(n) for n in names])


def onto(ds: Raster, height: int, width: int, rows: tuple[float, float, float], cols: tuple[float, float, float], method: str) -> DataFrame:
    """Pixels on a target grid. rows and cols: (num, den, shift) of each axis. Target pixels that no source pixel reaches have no row."""
    m = ds.meta
    down, across = Axis(method, *rows, m.height, height), Axis(method, *cols, m.width, width)
    if in_blocks(down, across):
        radius, kinds = math.ceil(max(down.reach, across.reach)) + 1, [contract.storage(m.dtype)] * m.count
        return tiles.pixels_of(tiles.surrounding(ds.tiles(), m.height, m.width, m.count, radius, weighing(down, across, m.dtype), kinds), m.count)
    bands = [e.alias(f"b{i}") for i, e in enumerate(ds._exprs, 1)]
    spread = ds._base.select(F.explode(_axis(method, F.col("row"), *rows, height)).alias("__r"), "col", *bands)
    spread = spread.select("__r", F.explode(_axis(method, F.col("col"), *cols, width)).alias("__c"), *[f"b{i}" for i in range(1, ds.meta.count + 1)])
    names = [f"b{i}" for i in range(1, ds.meta.count + 1)]
    if method == "nearest":
        return spread.select(F.col("__r.i").alias("row"), F.col("__c.i").alias("col"), *names)
    parts = spread.select(F.col("__r.i").alias("row"), F.col("__c.i").alias("col"), (F.col("__r.w") * F.col("__c.w")).alias("w"), *names)
    return combined(parts, method, ds.meta.dtype, ds.meta.count)


def to_shape(ds: Raster, height: int, width: int, method: str) -> Raster:
    m = ds.meta
    if height < 1 or width < 1:
        raise BackendError(f"can't resample to {height} x {width}")
    if (height, width) == m.shape and method == "nearest":
        return ds.derived(list(ds._exprs))
    df = onto(ds, height, width, (height, m.height, 0.0), (width, m.width, 0.0), method)
    return ds.replaced(df, height=height, width=width, transform=m.transform.scaled(m.width / width, m.height / height))


@raster_op
def resample(
    ds: Raster, *, size: tuple[int, int] | None = None, scale_factor: float | None = None, resolution: tuple[float, float] | None = None, resampling_method: Any = "nearest", plot_kwargs: Any = None, show_preview: bool = False
) -> Raster:
    """The whole extent on another grid: exactly one of size (height, width), scale_factor or resolution (x, y)."""
    if sum(v is not None for v in (size, scale_factor, resolution)) != 1:
        raise ValidationError("exactly one of size, scale_factor and resolution is asked for")
    method = normalize_resampling_method(resampling_method)
    m = ds.meta
    if size is not None:
        height, width = (int(v) for v in size)
    elif scale_factor is not None:
        height, width = int(m.height * scale_factor), int(m.width * scale_factor)
    else:
        x0, y0, x1, y1 = m.bounds
        width, height = int((x1 - x0) / abs(resolution[0])), int((y1 - y0) / abs(resolution[1]))
    return to_shape(ds, height, width, method)


def decimate(ds: Raster, height: int, width: int) -> Raster:
    """A coarse read: the nearest source pixel of each target pixel; pixels are dealt to targets where they lie, without a shuffle.

    A stored raster is read from the coarsest of its overviews that still has a pixel of its own for every target pixel.
    """
    m = ds.meta
    height, width = min(height, m.height), min(width, m.width)
    k = min(int(math.log2(m.height / height) + 1e-9), int(math.log2(m.width / width) + 1e-9), ds.overviews)
    if k < 1:
        return to_shape(ds, height, width, "nearest").with_meta(band_names=m.band_names)
    df = onto(ds.overview(k), height, width, (height, m.height / 2**k, 0.0), (width, m.width / 2**k, 0.0), "nearest")
    return ds.replaced(df, height=height, width=width, transform=m.transform.scaled(m.width / width, m.height / height), band_names=m.band_names)


def align_to(ds: Raster, target: Raster, method: Any = "bilinear") -> Raster:
    """ds on target's grid, by georeference; target pixels that ds doesn't reach are NULL."""
    method = normalize_resampling_method(method)
    a, b = ds.meta.transform, target.meta.transform
    if ds.meta.crs != target.meta.crs:
        raise CRSMismatchError(f"rasters lie in {ds.meta.crs} and {target.meta.crs}")
    if a.rotated or b.rotated:
        from .reproject import warp_onto

        return warp_onto(ds, target, method)
    # target centre (i + 0.5) lies at ((i + 0.5) * b.a + b.c - a.c) / a.a source pixels
    cols, rows = (a.a, b.a, (b.c - a.c) / a.a), (a.e, b.e, (b.f - a.f) / a.e)
    if cols[1] / cols[0] < 0 or rows[1] / rows[0] < 0:
        raise AlignmentError("grids that run in opposite directions can't be aligned")
    m = target.meta
    rows, cols = tuple(map(abs, rows[:2])) + rows[2:], tuple(map(abs, cols[:2])) + cols[2:]
    df = onto(ds, m.height, m.width, rows, cols, method)
    axes = Axis(method, *rows, ds.meta.height, m.height), Axis(method, *cols, ds.meta.width, m.width)
    if in_blocks(*axes):
        full = with_gaps(df, m.height, m.width, *[x.made_by(0, x.source) for x in axes])
    elif method in SUPPORT:  # a kernel wider than a quarter of a tile
        full = whole(ds.spark, m.height, m.width).join(df, ["row", "col"], "left")
    else:
        full = with_gaps(df, m.height, m.width, *[_touched(x) for x in axes])
    return ds.replaced(full, height=m.height, width=m.width, transform=m.transform)


def _touched(axis: Axis) -> tuple[int, int]:
    """The target pixels of an axis, from and to, that a nearest or area method gives a row, as in ``_axis``."""
    edge = lambda x: (x - axis.shift) * axis.num / axis.den
    if axis.method == "nearest":
        first, last = math.ceil(edge(0) - 0.5), math.ceil(edge(axis.source) - 0.5)
    else:
        first, last = math.floor(edge(0)), math.ceil(edge(axis.source))
        first += (first + 1) * axis.scale + axis.shift <= 1e-12
        last -= axis.source - ((last - 1) * axis.scale + axis.shift) <= 1e-12
    return min(max(first, 0), axis.target), min(max(last, 0), axis.target)


def with_gaps(df: DataFrame, height: int, width: int, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """df, which has all pixels of rows x cols, and rows of NULL for the rest of a grid: above, below, left and right of it."""
    if rows[0] >= rows[1] or cols[0] >= cols[1]:
        rows = cols = (0, 0)
    names = [c for c in df.columns if c not in ("row", "col")]
    frames = ((0, rows[0], 0, width), (rows[1], height, 0, width), (rows[0], rows[1], 0, cols[0]), (rows[0], rows[1], cols[1], width))
    for r0, r1, c0, c1 in frames:
        n = (r1 - r0) * (c1 - c0)
        if n > 0:
            at = df.sparkSession.range(n).select(F.expr(f"cast({r0} + id div {c1 - c0} as int)").alias("row"), F.expr(f"cast({c0} + id % {c1 - c0} as int)").alias("col"))
            df = df.unionByName(at.select("row", "col", *[F.lit(None).cast(df.schema[b].dataType).alias(b) for b in names]))
    return df
