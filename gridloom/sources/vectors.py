"""Vector files: shapefiles, GeoPackages and WKB, as GeoJSON texts with their CRS.

``spark.read.format("vectors").load(path)`` gives one row per feature with a polygon: id, geometry (GeoJSON), crs. Records are dealt
to tasks by the file's own index: offsets of a shapefile's index file, row numbers of a GeoPackage's table.
"""

from __future__ import annotations

import json
import os
import sqlite3
import struct
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import BackendError
from .arrays import session
from .ranges import local_path

#: Features that a task reads.
STEP = 10_000
#: Bytes of a GeoPackage geometry's envelope by its kind.
_ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}

Polygon = list[list[tuple[float, float]]]


def from_wkb(data: bytes, at: int = 0) -> tuple[list[Polygon], int]:
    """Polygons of a WKB or EWKB geometry, and where it ends; points and lines give none. Heights are left out."""
    order = "<" if data[at] == 1 else ">"
    kind = struct.unpack_from(order + "I", data, at + 1)[0]
    at += 5
    size = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000)
    if kind & 0x20000000:
        at += 4
    kind &= 0x0FFFFFFF
    size = {0: size, 1: 3, 2: 3, 3: 4}[kind // 1000]
    kind %= 1000

    def points(at: int) -> tuple[list[tuple[float, float]], int]:
        n = struct.unpack_from(order + "I", data, at)[0]
        flat = struct.unpack_from(f"{order}{n * size}d", data, at + 4)
        return [(flat[i], flat[i + 1]) for i in range(0, n * size, size)], at + 4 + 8 * n * size

    if kind == 1:
        return [], at + 8 * size
    if kind == 2:
        return [], points(at)[1]
    n, out = struct.unpack_from(order + "I", data, at)[0], []
    at += 4
    if kind == 3:
        rings: Polygon = []
        for _ in range(n):
            ring, at = points(at)
            rings.append(ring)
        return [rings] if rings else [], at
    if kind not in (4, 5, 6, 7):
        raise BackendError(f"unsupported WKB geometry {kind}")
    for _ in range(n):
        part, at = from_wkb(data, at)
        out += part
    return out, at


def _shapefile_index(path: str) -> list[tuple[int, int]]:
    """Offset and length of each record, in bytes."""
    with open(path[:-4] + ".shx", "rb") as f:
        f.seek(100)
        flat = f.read()
    return [(2 * a, 2 * b) for a, b in struct.iter_unpack(">ii", flat)]


def _shape(record: bytes) -> list[Polygon]:
    """The rings of a polygon record as one polygon: what is inside follows from their parity, holes included."""
    if len(record) < 4 or struct.unpack_from("<i", record)[0] not in (5, 15, 25):
        return []
    parts, points = struct.unpack_from("<ii", record, 36)
    starts = [*struct.unpack_from(f"<{parts}i", record, 44), points]
    flat = struct.unpack_from(f"<{2 * points}d", record, 44 + 4 * parts)
    rings = [[(flat[2 * i], flat[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]
    return [rings] if rings else []


def _table(path: str) -> tuple[str, str, str | None]:
    """Table, geometry column and CRS of a GeoPackage's first feature table."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        row = db.execute("SELECT g.table_name, g.column_name, s.organization, s.organization_coordsys_id FROM gpkg_geometry_columns g LEFT JOIN gpkg_spatial_ref_sys s ON g.srs_id = s.srs_id ORDER BY g.table_name").fetchone()
    if row is None:
        raise BackendError(f"{path} has no feature table")
    return row[0], row[1], f"EPSG:{row[3]}" if row[2] and row[2].upper() == "EPSG" else None


def crs_of(path: str) -> str | None:
    """The CRS that a vector file names."""
    path = local_path(os.fspath(path))
    if path.lower().endswith(".gpkg"):
        return _table(path)[2]
    prj = path[:-4] + ".prj"
    if path.lower().endswith(".shp") and os.path.exists(prj):
        with open(prj, encoding="utf-8") as f:
            return f.read().strip() or None
    return None


def features(path: str, first: int = 0, count: int | None = None) -> Iterator[tuple[int, list[Polygon]]]:
    """Number and polygons of a file's features, from one on."""
    path = local_path(path)
    if path.lower().endswith(".shp"):
        index = _shapefile_index(path)[first : None if count is None else first + count]
        with open(path, "rb") as f:
            for k, (at, n) in enumerate(index, first):
                f.seek(at + 8)
                yield k, _shape(f.read(n))
    elif path.lower().endswith(".gpkg"):
        table, column, _ = _table(path)
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            rows = db.execute(f'SELECT "{column}" FROM "{table}" ORDER BY rowid LIMIT ? OFFSET ?', (-1 if count is None else count, first))  # noqa: S608  names from the file's own catalogue
            for k, (blob,) in enumerate(rows, first):
                if blob and not blob[3] & 16:
                    yield k, from_wkb(blob, 8 + _ENVELOPE[blob[3] >> 1 & 7])[0]
                else:
                    yield k, []
    else:
        raise BackendError(f"{path} is no shapefile or GeoPackage")


def is_vector_file(value: Any) -> bool:
    return isinstance(value, (str, os.PathLike)) and os.fspath(value).lower().endswith((".shp", ".gpkg"))


def geojson(value: Any) -> dict:
    """A vector file, or WKB bytes, as one GeoJSON geometry."""
    if isinstance(value, (bytes, bytearray, memoryview)):
        found = from_wkb(bytes(value))[0]
    else:
        found = [p for _, polygons in features(os.fspath(value)) for p in polygons]
    return {"type": "MultiPolygon", "coordinates": found}


class Records(InputPartition):
    def __init__(self, first: int, count: int):
        self.first, self.count = first, count


class VectorReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.crs = path, crs_of(path)

    def partitions(self) -> list[InputPartition]:
        path = local_path(self.path)
        if path.lower().endswith(".shp"):
            n = len(_shapefile_index(path))
        else:
            table = _table(path)[0]
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                n = db.execute(f'SELECT count(*) FROM "{table}"').fetchone()[0]  # noqa: S608
        return [Records(a, STEP) for a in range(0, n, STEP)] or [Records(0, 0)]

    def read(self, partition: Records) -> Iterator[tuple]:
        for k, polygons in features(self.path, partition.first, partition.count):
            if polygons:
                yield k, json.dumps({"type": "MultiPolygon", "coordinates": polygons}), self.crs


class VectorSource(DataSource):
    """``spark.read.format("vectors").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        return "id long, geometry string, crs string"

    def reader(self, schema: Any) -> DataSourceReader:
        return VectorReader(self.options["path"])


def read_vectors(path: str | os.PathLike, spark=None) -> DataFrame:
    """id, geometry, crs of a vector file's polygon features."""
    spark, path = session(spark), os.fspath(path)
    if not os.path.exists(local_path(path)):
        raise FileNotFoundError(path)
    spark.dataSource.register(VectorSource)
    return spark.read.format("vectors").load(path)
