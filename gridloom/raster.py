"""The raster: immutable grid metadata on the driver, and one lazy plan over pixels.

A raster's pixels are a base DataFrame (row, col and other columns, one row per pixel) and one expression per band over its
columns. Operations on rasters that share a base only combine expressions, so ``scene.band(1) - scene.band(2)`` is a
projection and never a join; rasters of different bases join on (row, col).
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contract
from .errors import ValidationError
from .meta import RasterMeta, clean_names

#: Operations by name, as methods of Raster.
OPERATIONS: dict[str, Callable] = {}
#: Expressions nested deeper than this start a new base.
DEPTH = 24


class Raster:
    """A georeferenced grid of bands. Every operation returns a new raster and runs no job until pixels are asked for."""

    def __init__(self, meta: RasterMeta, base: DataFrame, exprs: list[Column] | None = None, depth: int = 0, path: str | None = None, tiled: bool = False):
        self.meta, self.path, self._tiled = meta, path, tiled  # tiled: the base has the pixels of each tile one after another
        self._levels: tuple[int, tuple[int, ...]] = (0, ())  # overviews stored at ``path``, and which of its bands these are
        self._reader: Callable[[int, int, int, int], DataFrame] | None = None  # the base of a window alone, where filters can't reach the file
        self._base = base
        self._exprs = list(exprs) if exprs is not None else [F.col(f"b{i}") for i in range(1, meta.count + 1)]
        self._depth = depth
        if len(self._exprs) != meta.count:
            raise ValidationError("a raster has one expression per band")

    # -- construction --

    @classmethod
    def from_table(cls, df: DataFrame, meta: RasterMeta, bands: list[str | Column] | None = None, row: str | Column = "row", col: str | Column = "col", key: str | None = None) -> Raster:
        """Pixels of a wide table; stored nodata become NULL. Every pixel of the grid has one row.

        ``key``: a column that counts pixels in row-major order; row and col follow from it, and windows become ranges of it
        that reach the scan.
        """
        if key is not None:
            row, col = F.expr(f"`{key}` div {meta.width}"), F.expr(f"`{key}` % {meta.width}")
        bands = bands if bands is not None else [f"b{i}" for i in range(1, meta.count + 1)]
        as_col = lambda c: F.col(c) if isinstance(c, str) else c
        values = [contract.decode(as_col(b).cast(contract.storage(meta.dtype)), meta.nodata, meta.dtype).alias(f"b{i}") for i, b in enumerate(bands, 1)]
        known = [F.col(key).alias(f"__key_{meta.width}")] if key is not None else []
        return cls(meta, df.select(as_col(row).cast("int").alias("row"), as_col(col).cast("int").alias("col"), *known, *values))

    @property
    def spark(self) -> SparkSession:
        return self._base.sparkSession

    @property
    def df(self) -> DataFrame:
        """The wide pixel table: row, col, b1 ... bN; nodata is NULL."""
        return self._base.select("row", "col", *[e.alias(f"b{i}") for i, e in enumerate(self._exprs, 1)])

    ds = df

    def rebased(self) -> Raster:
        """The same raster with its pixel table as its own base."""
        return Raster(self.meta, self.df, path=self.path, tiled=self._tiled)

    def derived(self, exprs: list[Column], *, depth: int | None = None, **changes: Any) -> Raster:
        """A raster over the same base; names, timestamp and attributes are passed on by methods, not here."""
        changes = {"count": len(exprs), "band_names": (), "timestamp": None, "attrs": {}} | changes
        out = Raster(replace(self.meta, **changes), self._base, exprs, (self._depth if depth is None else depth) + 1, tiled=self._tiled)
        out._reader = self._reader
        return out.rebased() if out._depth > DEPTH else out

    def replaced(self, df: DataFrame, **changes: Any) -> Raster:
        """A raster over new pixels, without names, timestamp and attributes."""
        changes = {"band_names": (), "timestamp": None, "attrs": {}} | changes
        return Raster(replace(self.meta, **changes), df)

    def with_meta(self, **changes: Any) -> Raster:
        out = Raster(replace(self.meta, **changes), self._base, self._exprs, self._depth, self.path, self._tiled)
        out._levels, out._reader = self._levels, self._reader
        return out

    def tiles(self, kinds: list[str] | None = None) -> DataFrame:
        """The pixels as blocks of a regular net (``operators.tiles``); those of a stored raster lie in place."""
        from .operators.tiles import tiles_of

        kinds = kinds or [contract.storage(self.meta.dtype)] * self.meta.count
        return tiles_of(self.df, self.meta.height, self.meta.width, kinds, in_place=self._tiled)

    @property
    def overviews(self) -> int:
        """How many coarser levels are stored beside the pixels, each of half the resolution of the one before."""
        return self._levels[0]

    def overview(self, level: int) -> Raster:
        """A stored level: pixel i stands for pixels 2^level * i and on, by the one in their middle."""
        from .sources.files import load_level

        if not 1 <= level <= self.overviews:
            raise ValidationError(f"level {level} of {self.overviews}")
        return load_level(self, level, self._levels[1])

    def persist(self) -> Raster:
        self._base.persist()
        return self

    materialize = persist

    def to_rasterio(self) -> Raster:
        """There is one backend: the raster itself."""
        return self

    def close(self) -> None:
        self._base.unpersist()

    # -- metadata: no jobs --

    def get_crs(self):
        return self.meta.crs

    def get_transform(self):
        return self.meta.transform

    def get_shape(self) -> tuple[int, int]:
        return self.meta.shape

    def get_bounds(self):
        return self.meta.bounds

    def get_width(self) -> int:
        return self.meta.width

    def get_height(self) -> int:
        return self.meta.height

    def get_count(self) -> int:
        return self.meta.count

    def get_metadata(self) -> dict:
        m = self.meta
        return {"driver": "gridloom", "dtype": m.dtype, "nodata": m.nodata, "width": m.width, "height": m.height, "count": m.count, "crs": m.crs, "transform": m.transform}

    def get_index(self) -> Callable[[float, float], tuple[int, int]]:
        """A function from (x, y) to (row, col)."""
        inverse = self.meta.transform.inverse()

        def index(x: float, y: float) -> tuple[int, int]:
            col, row = inverse.point(x, y)
            return int(np.floor(row)), int(np.floor(col))

        return index

    @property
    def timestamp(self):
        return self.meta.timestamp

    @property
    def attrs(self) -> dict:
        return self.meta.attrs

    @property
    def band_names(self) -> list[str | None]:
        return list(self.meta.band_names)

    @band_names.setter
    def band_names(self, names) -> None:
        self.meta = replace(self.meta, band_names=clean_names(names, self.meta.count) if names is not None else ())

    def set_band_name(self, band: int, new_name: str | None) -> None:
        names = list(self.meta.band_names)
        names[self.meta.band_index(band) - 1] = new_name
        self.band_names = names

    def __repr__(self) -> str:
        m = self.meta
        named = [n for n in m.band_names if n]
        names = f", bands={named[:4]}{'...' if len(named) > 4 else ''}" if named else ""
        return f"Raster({m.count} x {m.height} x {m.width}, {m.dtype}, crs={m.crs}, nodata={m.nodata}{names})"

    # -- pixels --

    def band(self, spec: int | str) -> Raster:
        """One band as a raster over the same base."""
        i = self.meta.band_index(spec)
        out = self.derived([self._exprs[i - 1]], depth=self._depth - 1, band_names=(self.meta.band_names[i - 1],), timestamp=self.meta.timestamp, attrs=self.meta.attrs)
        if self.overviews:
            out.path, out._levels = self.path, (self.overviews, (self._levels[1][i - 1],))
        return out

    def column(self, spec: int | str = 1) -> Column:
        """A band's expression over the base."""
        return self._exprs[self.meta.band_index(spec) - 1]

    def encoded(self) -> DataFrame:
        """The wide pixel table with nodata as stored outside: NaN or the sentinel."""
        m = self.meta
        return self._base.select("row", "col", *[contract.encode(e.cast(contract.storage(m.dtype)), m.nodata, m.dtype).alias(f"b{i}") for i, e in enumerate(self._exprs, 1)])

    def to_array(self) -> np.ndarray:
        """All pixels as (band, row, col) on the driver. For grids that fit there."""
        m = self.meta
        fill = m.nodata if m.nodata is not None else (np.nan if not contract.is_integer(m.dtype) and m.dtype != "bool" else 0)
        out = np.full((m.count, m.height, m.width), fill, np.dtype(m.dtype))
        table = self.encoded().toArrow()
        r, c = table.column("row").to_numpy(), table.column("col").to_numpy()
        for i in range(m.count):
            values = table.column(f"b{i + 1}")
            if values.null_count:
                values = values.fill_null(fill)
            out[i, r, c] = values.to_numpy()
        return out

    def read(self, indexes: int | list[int] | None = None, *, window: tuple[tuple[int, int], tuple[int, int]] | None = None, out_shape: tuple[int, ...] | None = None) -> np.ndarray:
        """Bands as arrays: of a ((row from, to), (col from, to)) window, decimated to ``out_shape``."""
        from .operators.clip import window_of
        from .operators.resample import decimate

        r = self
        if window is not None:
            r = window_of(r, window[0][0], window[1][0], window[0][1] - window[0][0], window[1][1] - window[1][0])
        if out_shape is not None:
            r = decimate(r, out_shape[-2], out_shape[-1])
        if isinstance(indexes, (int, str)):
            return r.band(indexes).to_array()[0]
        if indexes is not None:
            r = r.derived([r.column(i) for i in indexes], band_names=())
        return r.to_array()

    def get_band(self, spec: int | str) -> np.ndarray:
        return self.read(self.meta.band_index(spec))

    # -- operators --

    def __add__(self, other):
        return self.add(other)

    def __radd__(self, other):
        return self.add(other)

    def __sub__(self, other):
        return self.subtract(other)

    def __rsub__(self, other):
        return OPERATIONS["reverse_subtract"](self, other)

    def __mul__(self, other):
        return self.multiply(other)

    def __rmul__(self, other):
        return self.multiply(other)

    def __truediv__(self, other):
        return self.divide(other)

    def __rtruediv__(self, other):
        return OPERATIONS["reverse_divide"](self, other)

    def __pow__(self, exponent):
        return self.power(exponent)


def raster_op(func: Callable | None = None, *, preserve_none: bool = False, propagate_band_names: bool = True):
    """Binds a function of a raster as a method of Raster.

    The method's result takes over the raster's timestamp and attributes where it has none, and its band names where the
    result has as many bands and no names. A function that returns None gives the raster itself, unless ``preserve_none``.
    Called as a plain function it passes nothing on.
    """

    def bind(f: Callable) -> Callable:
        @functools.wraps(f)
        def method(self: Raster, *args, **kwargs):
            out = f(self, *args, **kwargs)
            if out is None:
                return None if preserve_none else self
            if not isinstance(out, Raster):
                return out
            changes: dict[str, Any] = {}
            if out.meta.timestamp is None:
                changes["timestamp"] = self.meta.timestamp
            if not out.meta.attrs:
                changes["attrs"] = dict(self.meta.attrs)
            if propagate_band_names and out.meta.count == self.meta.count and not any(out.meta.band_names):
                changes["band_names"] = self.meta.band_names
            return out.with_meta(**changes)

        OPERATIONS[f.__name__] = f
        setattr(Raster, f.__name__, method)
        return f

    return bind(func) if func else bind


def raster_viz(func: Callable) -> Callable:
    """Binds a terminal function that returns what a plot draws."""
    OPERATIONS[func.__name__] = func
    setattr(Raster, func.__name__, functools.wraps(func)(lambda self, *a, **k: func(self, *a, **k)))
    return func
