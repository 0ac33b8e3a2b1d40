"""Map projections and datum shifts as formulas: geographic, Mercator, transverse Mercator (UTM), Lambert conformal conic, Lambert
azimuthal equal-area, Albers, polar stereographic and sinusoidal, on any ellipsoid.

Each direction is written once over a set of functions, so the same formulas run on floats and on Spark columns. ``keep`` marks
what a formula uses more than once: on Spark it becomes a column of its own, so plans and generated code stay small. Latitudes
are found from auxiliary ones (conformal, authalic, rectifying) by sine series whose coefficients are computed here, for the
ellipsoid at hand, from the defining integral or formula; nothing iterates per point.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from types import SimpleNamespace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .crs import Definition, definition

_FLOATS = SimpleNamespace(sin=math.sin, cos=math.cos, tan=math.tan, sinh=math.sinh, cosh=math.cosh, asin=math.asin, atan2=math.atan2, asinh=math.asinh, atanh=math.atanh, exp=math.exp, log=math.log, sqrt=math.sqrt, atan=math.atan, hypot=math.hypot, least=min, greatest=max, floor=math.floor, keep=lambda e: e)
_ARRAYS = SimpleNamespace(sin=np.sin, cos=np.cos, tan=np.tan, sinh=np.sinh, cosh=np.cosh, asin=np.arcsin, atan2=np.arctan2, asinh=np.arcsinh, atanh=np.arctanh, exp=np.exp, log=np.log, sqrt=np.sqrt, atan=np.arctan, hypot=np.hypot, least=np.minimum, greatest=np.maximum, floor=np.floor, keep=lambda e: e)
_AS_COLUMN = lambda v: v if isinstance(v, Column) else F.lit(v)
_COLUMNS = SimpleNamespace(
    sin=F.sin, cos=F.cos, tan=F.tan, sinh=F.sinh, cosh=F.cosh, asin=F.asin, atan2=lambda y, x: F.atan2(_AS_COLUMN(y), _AS_COLUMN(x)), asinh=F.asinh, atanh=F.atanh, exp=F.exp, log=F.ln, sqrt=F.sqrt, atan=F.atan, floor=F.floor,
    hypot=lambda x, y: F.hypot(_AS_COLUMN(x), _AS_COLUMN(y)), least=lambda a, b: F.least(_AS_COLUMN(a), _AS_COLUMN(b)), greatest=lambda a, b: F.greatest(_AS_COLUMN(a), _AS_COLUMN(b)),
)
#: Terms of a series.
TERMS = 6


# -- auxiliary latitudes --


def _conformal(e: float, phi: Any) -> Any:
    return np.arctan(np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi))))


def _q(e: float, s: Any) -> Any:
    """Snyder's q of a latitude's sine: area from the equator."""
    if e < 1e-12:
        return 2 * s
    return (1 - e * e) * (s / (1 - e * e * s * s) + np.arctanh(e * s) / e)


def _authalic(e: float, phi: Any) -> Any:
    return np.arcsin(np.clip(_q(e, np.sin(phi)) / _q(e, 1.0), -1, 1))


@functools.lru_cache(maxsize=64)
def _quadrature() -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(40)


def _meridian(e: float, phi: Any) -> Any:
    """The arc from the equator, over the semi-major axis."""
    phi = np.asarray(phi, float)
    nodes, weights = _quadrature()
    at = phi[..., None] * (nodes + 1) / 2
    return (weights * (1 - e * e) / (1 - (e * np.sin(at)) ** 2) ** 1.5).sum(-1) * phi / 2


def _rectifying(e: float, phi: Any) -> Any:
    return _meridian(e, phi) / float(_meridian(e, math.pi / 2)) * (math.pi / 2)


_AUXILIARY: dict[str, Callable] = {"conformal": _conformal, "authalic": _authalic, "rectifying": _rectifying}


@functools.lru_cache(maxsize=256)
def series(kind: str, e: float, back: bool) -> tuple[float, ...]:
    """Coefficients c of aux = phi + sum c[j] sin(2 j phi), or, ``back``, of phi = aux + sum c[j] sin(2 j aux)."""
    f, n = _AUXILIARY[kind], 64
    at = (np.arange(n) + 0.5) * (math.pi / 2) / n
    other = f(e, at)
    if back:
        other = at.copy()
        for _ in range(30):
            other += at - f(e, other)
    return tuple(float(2 / n * ((other - at) * np.sin(2 * j * at)).sum()) for j in range(1, TERMS + 1))


def _moved(kind: str, e: float, back: bool, x: Any, m: Any) -> Any:
    if e < 1e-12:
        return x
    out = x
    for j, c in enumerate(series(kind, e, back), 1):
        out = out + m.sin(x * (2.0 * j)) * c
    return out


def _unit(x: Any, m: Any) -> Any:
    return m.least(m.greatest(x, -1.0), 1.0)


def _psi(e: float, phi: Any, m: Any) -> Any:
    """Isometric latitude."""
    s = m.keep(m.sin(phi))
    return m.atanh(s) - m.atanh(s * e) * e if e > 1e-12 else m.atanh(s)


def _scale(e: float, phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2)


def _from_psi(d: Definition, psi: Any, m: Any) -> Any:
    return _moved("conformal", d.e, True, m.keep(m.atan(m.sinh(psi))), m)


def _from_q(d: Definition, q: Any, m: Any) -> Any:
    return _moved("authalic", d.e, True, m.keep(m.asin(_unit(q / float(_q(d.e, 1.0)), m))), m)


def _area(d: Definition, phi: Any, m: Any) -> Any:
    s = m.keep(m.sin(phi))
    if d.e < 1e-12:
        return s * 2.0
    return (s / (1 - s * s * d.e2) + m.atanh(s * d.e) / d.e) * (1 - d.e2)


# -- projections: lam is the longitude from the central meridian; x and y are metres from the false origin --


def _merc(d: Definition) -> float:
    return d.axis * (d.k if d.lat_ts is None else _scale(d.e, d.lat_ts))


def merc_forward(d: Definition, lam: Any, phi: Any, m: Any) -> tuple[Any, Any]:
    return lam * _merc(d), _psi(d.e, phi, m) * _merc(d)


def merc_back(d: Definition, x: Any, y: Any, m: Any) -> tuple[Any, Any]:
    return x / _merc(d), _from_psi(d, y / _merc(d), m)


def _krueger(d: Definition) -> tuple[float, tuple[float, ...], tuple[float, ...]]:
    """Radius of the rectifying sphere, and Krüger's series by the third flattening, forward and back."""
    n = d.flattening / (2 - d.flattening)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    return d.k * d.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64), alpha, beta


def tmerc_forward(d: Definition, lam: Any, phi: Any, m: Any) -> tuple[Any, Any]:
    radius, alpha, _ = _krueger(d)
    start = d.k * d.axis * float(_meridian(d.e, d.lat_0))
    t = m.keep(m.sinh(_psi(d.e, phi, m)))
    xi0, eta0 = m.keep(m.atan2(t, m.cos(lam))), m.keep(m.atanh(m.sin(lam) / m.sqrt(t * t + 1)))
    xi, eta = xi0, eta0
    for j, a in enumerate(alpha, 1):
        xi = xi + m.sin(xi0 * (2 * j)) * m.cosh(eta0 * (2 * j)) * a
        eta = eta + m.cos(xi0 * (2 * j)) * m.sinh(eta0 * (2 * j)) * a
    return eta * radius, xi * radius - start


def tmerc_back(d: Definition, x: Any, y: Any, m: Any) -> tuple[Any, Any]:
    radius, _, beta = _krueger(d)
    xi0, eta0 = m.keep((y + d.k * d.axis * float(_meridian(d.e, d.lat_0))) / radius), m.keep(x / radius)
    xi, eta = xi0, eta0
    for j, b in enumerate(beta, 1):
        xi = xi - m.sin(xi0 * (2 * j)) * m.cosh(eta0 * (2 * j)) * b
        eta = eta - m.cos(xi0 * (2 * j)) * m.sinh(eta0 * (2 * j)) * b
    xi, s = m.keep(xi), m.keep(m.sinh(eta))
    chi = m.keep(m.atan2(m.sin(xi), m.hypot(s, m.cos(xi))))
    return m.atan2(s, m.cos(xi)), _moved("conformal", d.e, True, chi, m)


def _lcc(d: Definition) -> tuple[float, float, float]:
    """The cone's constant, the factor of distances from its tip, and that of the origin."""
    one = d.lat_1 if d.lat_1 is not None else d.lat_0
    two = d.lat_2 if d.lat_2 is not None else one
    psi = lambda phi: float(_psi(d.e, phi, _FLOATS))
    n = math.sin(one) if abs(one - two) < 1e-10 else math.log(_scale(d.e, one) / _scale(d.e, two)) / (psi(two) - psi(one))
    factor = d.k * d.axis * _scale(d.e, one) / n * math.exp(n * psi(one))
    return n, factor, 0.0 if abs(abs(d.lat_0) - math.pi / 2) < 1e-10 else factor * math.exp(-n * psi(d.lat_0))


def lcc_forward(d: Definition, lam: Any, phi: Any, m: Any) -> tuple[Any, Any]:
    n, factor, origin = _lcc(d)
    rho = m.keep(m.exp(_psi(d.e, phi, m) * -n) * factor)
    return rho * m.sin(lam * n), rho * m.cos(lam * n) * -1.0 + origin


def lcc_back(d: Definition, x: Any, y: Any, m: Any) -> tuple[Any, Any]:
    n, factor, origin = _lcc(d)
    sign, down = math.copysign(1.0, n), m.keep(y * -1.0 + origin)
    rho = m.hypot(x, down)
    return m.atan2(x * sign, down * sign) / n, _from_psi(d, m.log(rho / abs(factor)) / -n, m)


def _stere(d: Definition) -> float:
    e = d.e
    if d.lat_ts is None:
        return 2 * d.axis * d.k / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
    at = abs(d.lat_ts)
    if abs(at - math.pi / 2) < 1e-10:
        return 2 * d.axis / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
    return d.axis * _scale(e, at) * math.exp(_psi(e, at, _FLOATS))


def stere_forward(d: Definition, lam: Any, phi: Any, m: Any) -> tuple[Any, Any]:
    north = math.copysign(1.0, d.lat_0)
    rho = m.keep(m.exp(_psi(d.e, phi, m) * -north) * _stere(d))
    return rho * m.sin(lam), rho * m.cos(lam) * -north


def stere_back(d: Definition, x: Any, y: Any, m: Any) -> tuple[Any, Any]:
    north = math.copysign(1.0, d.lat_0)
    rho = m.greatest(m.hypot(x, y), 1e-12)
    return m.atan2(x, y * -north), _from_psi(d, m.log(rho / _stere(d)) * -north, m)


def _laea(d: Definition) -> tuple[float, float, float]:
    """Authalic radius, authalic latitude of the origin, and the factor between axes."""
    radius, beta = d.axis * math.sqrt(float(_q(d.e, 1.0)) / 2), float(_authalic(d.e, d.lat_0))
    return radius, beta, d.axis * _scale(d.e, d.lat_0) / (radius * math.cos(beta)) if abs(abs(d.lat_0) - math.pi / 2) > 1e-9 else 1.0


def laea_forward(d: Definition, lam: Any, phi: Any, m: Any) -> tuple[Any, Any]:
    radius, beta_0, ratio = _laea(d)
    q = float(_q(d.e, 1.0))
    if abs(abs(d.lat_0) - math.pi / 2) < 1e-9:
        north = math.copysign(1.0, d.lat_0)
        rho = m.keep(m.sqrt(m.greatest(_area(d, phi, m) * -north + q, 0.0)) * d.axis)
        return rho * m.sin(lam), rho * m.cos(lam) * -north
    beta = m.keep(m.asin(_unit(_area(d, phi, m) / q, m)))
    s, c = m.keep(m.sin(beta)), m.keep(m.cos(beta))
    b = m.keep(m.sqrt(2.0 / (1.0 + s * math.sin(beta_0) + c * m.cos(lam) * math.cos(beta_0))) * radius)
    return b * c * m.sin(lam) * ratio, b * (s * math.cos(beta_0) - c * m.cos(lam) * math.sin(beta_0)) / ratio


def laea_back(d: Definition, x: Any, y: Any, m: Any) -> tuple[Any, Any]:
    radius, beta_0, ratio = _laea(d)
    q = float(_q(d.e, 1.0))
    if abs(abs(d.lat_0) - math.pi / 2) < 1e-9:
        north = math.copysign(1.0, d.lat_0)
        return m.atan2(x, y * -north), _from_q(d, ((x * x + y * y) / -(d.axis**2) + q) * north, m)
    u, v = m.keep(x / ratio), m.keep(y * ratio)
    rho = m.keep(m.greatest(m.hypot(u, v), 1e-9))
    angle = m.keep(m.asin(_unit(rho / (2 * radius), m)) * 2.0)
    s, c = m.keep(m.sin(angle)), m.keep(m.cos(angle))
    beta = m.keep(m.asin(_unit(c * math.sin(beta_0) + v * s * math.cos(beta_0) / rho, m)))
    return m.atan2(u * s, rho * c * math.cos(beta_0) - v * s * math.sin(beta_0)), _moved("authalic", d.e, True, beta, m)


def _aea(d: Definition) -> tuple[float, float, float]:
    two = d.lat_2 if d.lat_2 is not None else d.lat_1
    m1, m2, q1, q2, q0 = _scale(d.e, d.lat_1), _scale(d.e, two), *[float(_q(d.e, math.sin(p))) for p in (d.lat_1, two, d.lat_0)]
    n = math.sin(d.lat_1) if abs(d.lat_1 - two) < 1e-10 else (m1 * m1 - m2 * m2) / (q2 - q1)
    c = m1 * m1 + n * q1
    return n, c, d.axis * math.sqrt(c - n * q0) / n


def aea_forward(d: Definition, lam: Any, phi: Any, m: Any) -> tuple[Any, Any]:
    n, c, origin = _aea(d)
    rho = m.keep(m.sqrt(m.greatest(_area(d, phi, m) * -n + c, 0.0)) * (d.axis / n))
    return rho * m.sin(lam * n), rho * m.cos(lam * n) * -1.0 + origin


def aea_back(d: Definition, x: Any, y: Any, m: Any) -> tuple[Any, Any]:
    n, c, origin = _aea(d)
    sign, down = math.copysign(1.0, n), m.keep(y * -1.0 + origin)
    return m.atan2(x * sign, down * sign) / n, _from_q(d, ((x * x + down * down) * -((n / d.axis) ** 2) + c) / n, m)


def sinu_forward(d: Definition, lam: Any, phi: Any, m: Any) -> tuple[Any, Any]:
    s = m.keep(m.sin(phi))
    quarter = float(_meridian(d.e, math.pi / 2)) * d.axis / (math.pi / 2)
    return lam * m.cos(phi) / m.sqrt(1 - s * s * d.e2) * d.axis, _moved("rectifying", d.e, False, phi, m) * quarter


def sinu_back(d: Definition, x: Any, y: Any, m: Any) -> tuple[Any, Any]:
    quarter = float(_meridian(d.e, math.pi / 2)) * d.axis / (math.pi / 2)
    phi = m.keep(_moved("rectifying", d.e, True, m.keep(y / quarter), m))
    s = m.keep(m.sin(phi))
    return x * m.sqrt(1 - s * s * d.e2) / (m.greatest(m.cos(phi), 1e-12) * d.axis), phi


_FORWARD = {"merc": merc_forward, "tmerc": tmerc_forward, "lcc": lcc_forward, "laea": laea_forward, "aea": aea_forward, "stere": stere_forward, "sinu": sinu_forward}
_BACK = {"merc": merc_back, "tmerc": tmerc_back, "lcc": lcc_back, "laea": laea_back, "aea": aea_back, "stere": stere_back, "sinu": sinu_back}


def _project(d: Definition, lam: Any, phi: Any, m: Any) -> tuple[Any, Any]:
    """Longitude and latitude, in radians, to a CRS's coordinates; a cone's or azimuth's angle is brought to +-180 degrees."""
    if d.geographic:
        return lam * (180 / math.pi), phi * (180 / math.pi)
    lam = m.keep(lam - d.lon_0)
    if d.family in ("lcc", "aea", "sinu"):
        lam = m.keep(m.atan2(m.sin(lam), m.cos(lam)))
    x, y = _FORWARD[d.family](d, lam, m.keep(phi), m)
    return (x + d.x_0) / d.unit, (y + d.y_0) / d.unit


def _unproject(d: Definition, x: Any, y: Any, m: Any) -> tuple[Any, Any]:
    if d.geographic:
        return x * (math.pi / 180), y * (math.pi / 180)
    lam, phi = _BACK[d.family](d, m.keep(x * d.unit - d.x_0), m.keep(y * d.unit - d.y_0), m)
    if d.lon_0 and d.family in ("lcc", "aea", "laea", "stere"):  # these go round a pole: longitudes are brought to +-180 degrees
        lam = m.keep(lam + d.lon_0)
        return lam - m.floor((lam + math.pi) / (2 * math.pi)) * (2 * math.pi), phi
    return lam + d.lon_0, phi


# -- datums --


def _shift_matrix(shift: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """T and M of WGS 84 = T + M x: a position vector transformation, rotations in seconds, scale in parts per million."""
    t = np.array(shift[:3])
    rx, ry, rz, s = (*(math.radians(v / 3600) for v in shift[3:6]), shift[6] * 1e-6) if len(shift) == 7 else (0.0, 0.0, 0.0, 0.0)
    return t, (1 + s) * np.array([[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]])


def _shifted(source: Definition, target: Definition, t: np.ndarray, matrix: np.ndarray, lam: Any, phi: Any, m: Any) -> tuple[Any, Any]:
    """A place on one ellipsoid as a place on another, by T + M x of its cartesian coordinates."""
    s, c = m.keep(m.sin(phi)), m.keep(m.cos(phi))
    n = m.keep(source.axis / m.sqrt(1 - s * s * source.e2))
    own = m.keep(n * c * m.cos(lam)), m.keep(n * c * m.sin(lam)), m.keep(n * s * (1 - source.e2))
    x, y, z = (m.keep(own[0] * float(r[0]) + own[1] * float(r[1]) + own[2] * float(r[2]) + float(k)) for r, k in zip(matrix, t, strict=True))
    b, p = target.axis * (1 - target.flattening), m.keep(m.hypot(x, y))
    theta = m.keep(m.atan2(z * target.axis, p * b))
    st, ct = m.keep(m.sin(theta)), m.keep(m.cos(theta))
    over = target.e2 / (1 - target.e2)
    return m.atan2(y, x), m.atan2(z + st * st * st * (over * b), p - ct * ct * ct * (target.e2 * target.axis))


_WGS84 = definition("EPSG:4326")


def _to_wgs84(d: Definition, lam: Any, phi: Any, m: Any) -> tuple[Any, Any]:
    return _shifted(d, _WGS84, *_shift_matrix(d.shift), m.keep(lam), m.keep(phi), m) if d.shift else (lam, phi)


def _from_wgs84(d: Definition, lam: Any, phi: Any, m: Any) -> tuple[Any, Any]:
    """The inverse of ``_to_wgs84``: by the inverse matrix, and one correction for the height that both leave out."""
    if not d.shift:
        return lam, phi
    t, matrix = _shift_matrix(d.shift)
    back = np.linalg.inv(matrix)
    lam, phi = m.keep(lam), m.keep(phi)
    first = [m.keep(v) for v in _shifted(_WGS84, d, -back @ t, back, lam, phi, m)]
    again = _to_wgs84(d, *first, m)
    return first[0] + (lam - again[0]), first[1] + (phi - again[1])


# -- the whole way --


def _same(a: Definition, b: Definition) -> bool:
    return a == b


def _convert(a: Definition, b: Definition, x: Any, y: Any, m: Any) -> tuple[Any, Any]:
    lam, phi = _unproject(a, x, y, m)
    if a.shift != b.shift or (a.shift and (a.axis, a.flattening) != (b.axis, b.flattening)):
        lam, phi = _from_wgs84(b, *_to_wgs84(a, lam, phi, m), m)
    return _project(b, lam, phi, m)


def convert(source: str | None, target: str | None, x: float, y: float) -> tuple[float, float]:
    """A point from one CRS to another."""
    a, b = definition(source), definition(target)
    return (x, y) if _same(a, b) else _convert(a, b, x, y, _FLOATS)


def convert_arrays(source: str | None, target: str | None, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points, as arrays; those that a projection doesn't reach are NaN or infinite."""
    a, b = definition(source), definition(target)
    if _same(a, b):
        return x, y
    with np.errstate(all="ignore"):
        return _convert(a, b, x, y, _ARRAYS)


def convert_columns(df: DataFrame, source: str | None, target: str | None, x: Column, y: Column) -> tuple[DataFrame, Column, Column]:
    """The table with columns for intermediate values, and the converted coordinates over it."""
    a, b = definition(source), definition(target)
    if _same(a, b):
        return df, x, y
    frames = [df]

    def keep(e: Any) -> Any:
        if not isinstance(e, Column):
            return e
        frames.append(frames[-1].withColumn(f"__p{len(frames)}", e))
        return F.col(f"__p{len(frames) - 1}")

    x, y = _convert(a, b, x, y, SimpleNamespace(**vars(_COLUMNS), keep=keep))
    return frames[-1], x, y


def convert_bounds(source: str | None, target: str | None, box: tuple[float, float, float, float], points: int = 21) -> tuple[float, float, float, float]:
    """The bounds of a box in another CRS, from points along its edges."""
    w, s, e, n = box
    f = np.linspace(0.0, 1.0, points)
    xs = np.concatenate([w + f * (e - w), w + f * (e - w), np.full(points, w), np.full(points, e)])
    ys = np.concatenate([np.full(points, s), np.full(points, n), s + f * (n - s), s + f * (n - s)])
    x, y = convert_arrays(source, target, xs, ys)
    return float(x.min()), float(y.min()), float(x.max()), float(y.max())
