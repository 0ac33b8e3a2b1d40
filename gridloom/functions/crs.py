"""Coordinate reference systems: EPSG numbers, PROJ strings and WKT, parsed to the numbers that projections need."""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass, field

from ..errors import ValidationError

#: Ellipsoids by name, semi-major axis and inverse flattening (0: a sphere).
ELLIPSOIDS = {
    "WGS84": (6378137.0, 298.257223563),
    "GRS80": (6378137.0, 298.257222101),
    "WGS72": (6378135.0, 298.26),
    "airy": (6377563.396, 299.3249646),
    "bessel": (6377397.155, 299.1528128),
    "clrk66": (6378206.4, 294.9786982),
    "clrk80ign": (6378249.2, 293.4660213),
    "intl": (6378388.0, 297.0),
    "krass": (6378245.0, 298.3),
    "sphere": (6370997.0, 0.0),
}
#: Datums by name, ellipsoid and shift to WGS 84.
DATUMS = {"WGS84": ("WGS84", ()), "NAD83": ("GRS80", ()), "OSGB36": ("airy", (446.448, -125.157, 542.06, 0.1502, 0.247, 0.8421, -20.4894)), "potsdam": ("bessel", (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7)), "hermannskogel": ("bessel", (577.326, 90.129, 463.919, 5.137, 1.474, 5.297, 2.4232))}
#: Definitions of common EPSG numbers.
EPSG = {
    3034: "+proj=lcc +lat_0=52 +lon_0=10 +lat_1=35 +lat_2=65 +x_0=4000000 +y_0=2800000 +ellps=GRS80",
    3035: "+proj=laea +lat_0=52 +lon_0=10 +x_0=4321000 +y_0=3210000 +ellps=GRS80",
    2154: "+proj=lcc +lat_0=46.5 +lon_0=3 +lat_1=49 +lat_2=44 +x_0=700000 +y_0=6600000 +ellps=GRS80",
    5070: "+proj=aea +lat_0=23 +lon_0=-96 +lat_1=29.5 +lat_2=45.5 +x_0=0 +y_0=0 +datum=NAD83",
    3577: "+proj=aea +lat_0=0 +lon_0=132 +lat_1=-18 +lat_2=-36 +x_0=0 +y_0=0 +ellps=GRS80",
    3031: "+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=0 +x_0=0 +y_0=0 +datum=WGS84",
    3413: "+proj=stere +lat_0=90 +lat_ts=70 +lon_0=-45 +x_0=0 +y_0=0 +datum=WGS84",
    3995: "+proj=stere +lat_0=90 +lat_ts=71 +lon_0=0 +x_0=0 +y_0=0 +datum=WGS84",
    32661: "+proj=stere +lat_0=90 +k=0.994 +lon_0=0 +x_0=2000000 +y_0=2000000 +datum=WGS84",
    32761: "+proj=stere +lat_0=-90 +k=0.994 +lon_0=0 +x_0=2000000 +y_0=2000000 +datum=WGS84",
    3395: "+proj=merc +lon_0=0 +k=1 +x_0=0 +y_0=0 +datum=WGS84",
    6931: "+proj=laea +lat_0=90 +lon_0=0 +x_0=0 +y_0=0 +datum=WGS84",
    6932: "+proj=laea +lat_0=-90 +lon_0=0 +x_0=0 +y_0=0 +datum=WGS84",
    27700: "+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +datum=OSGB36",
    31467: "+proj=tmerc +lat_0=0 +lon_0=9 +k=1 +x_0=3500000 +y_0=0 +datum=potsdam",
}
#: Projections and parameters as WKT names them.
WKT_PROJECTIONS = {"transverse_mercator": "tmerc", "lambert_conformal_conic_1sp": "lcc", "lambert_conformal_conic_2sp": "lcc", "lambert_conformal_conic": "lcc", "lambert_azimuthal_equal_area": "laea", "albers_conic_equal_area": "aea", "albers": "aea", "polar_stereographic": "stere", "mercator_1sp": "merc", "mercator_2sp": "merc", "mercator": "merc", "sinusoidal": "sinu"}
WKT_PARAMETERS = {"latitude_of_origin": "lat_0", "latitude_of_center": "lat_0", "central_meridian": "lon_0", "longitude_of_center": "lon_0", "standard_parallel_1": "lat_1", "standard_parallel_2": "lat_2", "scale_factor": "k", "false_easting": "x_0", "false_northing": "y_0"}
FAMILIES = ("longlat", "merc", "tmerc", "lcc", "laea", "aea", "stere", "sinu")


@dataclass(frozen=True)
class Definition:
    """A parsed CRS: angles in radians, lengths in metres; ``shift``: three or seven numbers to WGS 84, rotations in seconds."""

    family: str
    axis: float
    flattening: float
    lat_0: float = 0.0
    lon_0: float = 0.0
    lat_1: float | None = None
    lat_2: float | None = None
    lat_ts: float | None = None
    k: float = 1.0
    x_0: float = 0.0
    y_0: float = 0.0
    unit: float = 1.0
    shift: tuple[float, ...] = field(default=())

    @property
    def e2(self) -> float:
        return self.flattening * (2 - self.flattening)

    @property
    def e(self) -> float:
        return math.sqrt(self.e2)

    @property
    def geographic(self) -> bool:
        return self.family == "longlat"


@functools.lru_cache(maxsize=256)
def definition(crs: str | None) -> Definition:
    """What a CRS string stands for; an error says what is supported."""
    text = (crs or "").strip()
    number = int(text[5:]) if text.upper().startswith("EPSG:") and text[5:].isdigit() else None
    if number is not None:
        return _proj(_numbered(number))
    if text.startswith("+"):
        return _proj(text)
    if re.match(r"(PROJCS|GEOGCS)\s*\[", text):
        return _wkt(text)
    raise ValidationError(f"{crs} isn't supported: an EPSG number, a PROJ string or WKT is")


def _numbered(n: int) -> str:
    if n in EPSG:
        return EPSG[n]
    if n in (4326, 4258, 4269):
        return "+proj=longlat +ellps=" + ("WGS84" if n == 4326 else "GRS80")
    if n == 3857:
        return "+proj=merc +a=6378137 +b=6378137 +lon_0=0 +x_0=0 +y_0=0 +k=1 +nadgrids=@null"
    zones = {32600: (60, "+datum=WGS84"), 32700: (60, "+datum=WGS84 +south"), 25800: (60, "+ellps=GRS80"), 26900: (23, "+datum=NAD83")}
    count, datum = zones.get(n // 100 * 100, (0, ""))
    if 1 <= n % 100 <= count:
        return f"+proj=utm +zone={n % 100} {datum}"
    raise ValidationError(f"EPSG:{n} isn't supported by number; its PROJ string or WKT may be")


def _proj(text: str) -> Definition:
    given = dict((m[1], m[2] or "") for m in re.finditer(r"\+([A-Za-z_0-9]+)(?:=(\S+))?", text))
    family = {"latlong": "longlat", "utm": "tmerc"}.get(given.get("proj", ""), given.get("proj", ""))
    if family not in FAMILIES:
        raise ValidationError(f"projection {given.get('proj')!r} isn't supported; these are: {', '.join(FAMILIES)}, utm")
    name, shift = DATUMS.get(given.get("datum", ""), (given.get("ellps", "WGS84"), ()))
    if "datum" in given and given["datum"] not in DATUMS or name not in ELLIPSOIDS:
        raise ValidationError(f"datum {given.get('datum')!r} with ellipsoid {name!r} isn't known")
    axis, inverse = ELLIPSOIDS[name]
    flattening = 1 / inverse if inverse else 0.0
    if "R" in given:
        axis, flattening = float(given["R"]), 0.0
    if "a" in given:
        axis = float(given["a"])
        flattening = 1 / float(given["rf"]) if "rf" in given else (1 - float(given["b"]) / axis if "b" in given else flattening)
    if "towgs84" in given:
        shift = tuple(map(float, given["towgs84"].split(",")))
    number = lambda key, default=None: float(given[key]) if key in given else default
    angle = lambda key, default=None: math.radians(number(key)) if key in given else default
    values = {"lat_0": angle("lat_0", 0.0), "lon_0": angle("lon_0", 0.0), "lat_1": angle("lat_1"), "lat_2": angle("lat_2"), "lat_ts": angle("lat_ts"), "k": number("k_0", number("k", 1.0)), "x_0": number("x_0", 0.0), "y_0": number("y_0", 0.0)}
    if given["proj"] == "utm":
        values |= {"lon_0": math.radians(int(given["zone"]) * 6 - 183), "k": 0.9996, "x_0": 500000.0, "y_0": 10000000.0 if "south" in given else 0.0}
    unit = number("to_meter", {"ft": 0.3048, "us-ft": 1200 / 3937, "km": 1000.0}.get(given.get("units", "m"), 1.0))
    return _checked(Definition(family, axis, flattening, **values, unit=unit, shift=_clean_shift(shift)))


def _clean_shift(shift: tuple[float, ...]) -> tuple[float, ...]:
    if len(shift) not in (0, 3, 7):
        raise ValidationError("a datum shift has three or seven numbers")
    return shift if any(shift) else ()


def _wkt(text: str) -> Definition:
    pick = lambda key: re.search(rf'\b{key}\s*\[\s*"([^"]*)"\s*,?\s*([^\[\]]*)', text, re.I)
    body = pick("SPHEROID") or pick("ELLIPSOID")
    if not body:
        raise ValidationError("the WKT names no ellipsoid")
    axis, inverse = (float(v) for v in body[2].split(",")[:2])
    moved = re.search(r"TOWGS84\s*\[([^\]]*)\]", text, re.I)
    shift = tuple(float(v) for v in moved[1].split(",")) if moved else ()
    flattening = 1 / inverse if inverse else 0.0
    if text.upper().startswith("GEOGCS"):
        return Definition("longlat", axis, flattening, shift=_clean_shift(shift))
    name = (pick("PROJECTION") or [None, ""])[1].strip().lower().replace(" ", "_")
    if name not in WKT_PROJECTIONS:
        raise ValidationError(f"projection {name!r} isn't supported")
    family, values = WKT_PROJECTIONS[name], {}
    units = re.findall(r'\bUNIT\s*\[\s*"[^"]*"\s*,\s*([-+0-9.eE]+)', text)
    unit = float(units[-1]) if units else 1.0
    for key, value in re.findall(r'\bPARAMETER\s*\[\s*"([^"]*)"\s*,\s*([-+0-9.eE]+)', text):
        key = WKT_PARAMETERS.get(key.strip().lower().replace(" ", "_"))
        if key:
            values[key] = float(value) * (unit if key in ("x_0", "y_0") else 1.0)
    values = {k: math.radians(v) if k.startswith("l") else v for k, v in values.items()}
    if family == "stere":  # the parallel of true scale stands where others have their origin
        at = values.get("lat_0", math.pi / 2)
        values |= {"lat_0": math.copysign(math.pi / 2, at)} | ({"lat_ts": at} if abs(at) < math.pi / 2 - 1e-9 else {})
    if family == "merc" and "lat_1" in values:
        values["lat_ts"] = values.pop("lat_1")
    return _checked(Definition(family, axis, flattening, **values, unit=unit, shift=_clean_shift(shift)))


def _checked(d: Definition) -> Definition:
    if d.family == "stere" and abs(abs(d.lat_0) - math.pi / 2) > 1e-9:
        raise ValidationError("stereographic projections are supported at the poles")
    if d.family == "aea" and (d.lat_1 is None or abs(d.lat_1 + (d.lat_1 if d.lat_2 is None else d.lat_2)) < 1e-9):
        raise ValidationError("an equal-area cone has parallels that aren't opposite")
    if d.family == "lcc" and d.lat_2 is not None and abs((d.lat_1 or 0.0) + d.lat_2) < 1e-9:
        raise ValidationError("a conformal cone has parallels that aren't opposite")
    return d
