"""Grid metadata, held on the driver: it never needs a Spark job."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace
from datetime import datetime
from typing import Any

import numpy as np

from .errors import ValidationError


@dataclass(frozen=True)
class Affine:
    """x = a * col + b * row + c, y = d * col + e * row + f; (col, row) is a pixel's upper left corner."""

    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 0.0
    e: float = -1.0
    f: float = 0.0

    @classmethod
    def of(cls, value: Any) -> Affine:
        return value if isinstance(value, cls) else cls(*(float(v) for v in tuple(value)[:6]))

    @classmethod
    def from_origin(cls, west: float, north: float, xsize: float, ysize: float) -> Affine:
        return cls(xsize, 0.0, west, 0.0, -ysize, north)

    def __iter__(self):
        return iter((self.a, self.b, self.c, self.d, self.e, self.f))

    def point(self, col: float, row: float) -> tuple[float, float]:
        return self.a * col + self.b * row + self.c, self.d * col + self.e * row + self.f

    def inverse(self) -> Affine:
        det = self.a * self.e - self.b * self.d
        if det == 0:
            raise ValidationError("the transform can't be inverted")
        a, b, d, e = self.e / det, -self.b / det, -self.d / det, self.a / det
        return Affine(a, b, -a * self.c - b * self.f, d, e, -d * self.c - e * self.f)

    def scaled(self, x: float, y: float) -> Affine:
        return Affine(self.a * x, self.b * y, self.c, self.d * x, self.e * y, self.f)

    def shifted(self, col: float, row: float) -> Affine:
        c, f = self.point(col, row)
        return replace(self, c=c, f=f)

    @property
    def rotated(self) -> bool:
        return self.b != 0 or self.d != 0


#: Spark storage of each pixel type; Spark has no unsigned types.
STORAGE = {"int8": "tinyint", "uint8": "smallint", "int16": "smallint", "uint16": "int", "int32": "int", "uint32": "bigint", "int64": "bigint", "float32": "float", "float64": "double", "bool": "boolean"}


def clean_nodata(nodata: Any, dtype: str) -> float | int | None:
    """nodata as a Python number; one that the type can't hold is refused."""
    if nodata is None:
        return None
    value = float(nodata)
    if np.issubdtype(np.dtype(dtype), np.integer):
        if math.isnan(value):
            raise ValidationError(f"NaN can't be nodata of {dtype}")
        info = np.iinfo(dtype)
        if value != int(value) or not info.min <= int(value) <= info.max:
            raise ValidationError(f"nodata {nodata} is outside {dtype}")
        return int(value)
    return value


def clean_names(names: Any, count: int) -> tuple[str | None, ...]:
    if names is None:
        return (None,) * count
    if isinstance(names, str):
        raise ValidationError("band names are a sequence of strings")
    names = list(names)
    if len(names) != count:
        raise ValidationError(f"{len(names)} names for {count} bands")
    for n in names:
        if n is not None and not isinstance(n, str):
            raise ValidationError("a band name is a string or None")
    return tuple((n.strip() or None) if n is not None else None for n in names)


def clean_crs(crs: Any) -> str | None:
    """EPSG codes as ``EPSG:n``; other strings as given."""
    if crs is None:
        return None
    if isinstance(crs, bool):
        raise ValidationError("a CRS is a code or a string")
    if isinstance(crs, int):
        return f"EPSG:{crs}"
    if not isinstance(crs, str):
        to = getattr(crs, "to_string", None)
        if to is None:
            raise ValidationError("a CRS is a code or a string")
        crs = to()
    crs = crs.strip()
    m = re.fullmatch(r"(?:epsg:+)?(\d+)", crs, re.I) or re.fullmatch(r"urn:ogc:def:crs:epsg:[^:]*:(\d+)", crs, re.I)
    return f"EPSG:{m[1]}" if m else ("EPSG:4326" if crs.upper() in ("OGC:CRS84", "CRS84") else crs)


@dataclass(frozen=True)
class RasterMeta:
    height: int
    width: int
    dtype: str
    count: int = 1
    transform: Affine = field(default_factory=Affine)
    crs: str | None = None
    nodata: float | int | None = None
    band_names: tuple[str | None, ...] = ()
    timestamp: datetime | None = None
    attrs: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.dtype not in STORAGE:
            raise ValidationError(f"unsupported pixel type {self.dtype}")
        object.__setattr__(self, "transform", Affine.of(self.transform))
        object.__setattr__(self, "crs", clean_crs(self.crs))
        object.__setattr__(self, "nodata", clean_nodata(self.nodata, self.dtype))
        object.__setattr__(self, "band_names", clean_names(self.band_names or None, self.count))
        object.__setattr__(self, "attrs", dict(self.attrs))

    @property
    def shape(self) -> tuple[int, int]:
        return self.height, self.width

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        corners = [self.transform.point(c, r) for c in (0, self.width) for r in (0, self.height)]
        xs, ys = [p[0] for p in corners], [p[1] for p in corners]
        return min(xs), min(ys), max(xs), max(ys)

    def band_index(self, spec: Any) -> int:
        """A 1-based index from an index or a name (without regard to case and outer blanks)."""
        if isinstance(spec, bool) or not isinstance(spec, (int, np.integer, str)):
            raise ValidationError(f"a band is an index or a name, not {spec!r}")
        if isinstance(spec, str):
            wanted = spec.strip().casefold()
            found = [i for i, n in enumerate(self.band_names, 1) if n is not None and n.casefold() == wanted]
            if len(found) != 1:
                raise ValidationError(f"band name {spec!r} is {'ambiguous' if found else 'unknown'}; names are {list(self.band_names)}")
            return found[0]
        if not 1 <= int(spec) <= self.count:
            raise IndexError(f"band {spec} of {self.count}")
        return int(spec)

    def same_grid(self, other: RasterMeta) -> bool:
        return self.shape == other.shape and self.crs == other.crs and all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(self.transform, other.transform, strict=True))
