"""Polygons from GeoJSON mappings, and their rasterisation as per-row column intervals."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..meta import Affine, clean_crs

Ring = list[tuple[float, float]]


def polygons(value: Any) -> list[list[Ring]]:
    """Polygons (lists of rings) of a geometry, Feature, FeatureCollection, JSON text, file path, WKB or ``__geo_interface__``."""
    from ..sources import vectors

    if vectors.is_vector_file(value) or isinstance(value, (bytes, bytearray, memoryview)):
        value = vectors.geojson(value)
    if hasattr(value, "__geo_interface__"):
        value = value.__geo_interface__
    if isinstance(value, str):
        text = value if value.lstrip().startswith("{") else open(value, encoding="utf-8").read()
        value = json.loads(text)
    if not isinstance(value, dict):
        raise ValidationError("a geometry is a GeoJSON mapping, its text or a file of it")
    kind = value.get("type")
    if kind == "FeatureCollection":
        out = [p for f in value.get("features") or [] for p in polygons(f)]
    elif kind == "Feature":
        out = polygons(value["geometry"]) if value.get("geometry") else []
    elif kind == "GeometryCollection":
        out = [p for g in value.get("geometries") or [] for p in polygons(g)]
    elif kind == "Polygon":
        out = [value["coordinates"]]
    elif kind == "MultiPolygon":
        out = list(value["coordinates"])
    else:
        raise ValidationError(f"a polygon is asked for, not {kind}")
    cleaned = []
    for polygon in out:
        rings = [[(float(p[0]), float(p[1])) for p in ring] for ring in polygon]
        rings = [r if r[0] == r[-1] else [*r, r[0]] for r in rings if len(r) >= 3]
        if rings:
            cleaned.append(rings)
    if not cleaned:
        raise ValidationError("the geometry is empty")
    return cleaned


def declared_crs(value: Any) -> str | None:
    """The CRS that a GeoJSON mapping or a vector file names, if any."""
    from ..sources import vectors

    if vectors.is_vector_file(value):
        named = vectors.crs_of(value)
        return clean_crs(named) if named else None
    if isinstance(value, dict):
        name = ((value.get("crs") or {}).get("properties") or {}).get("name")
        return clean_crs(name) if name else None
    return None


def bounds(shapes: list[list[Ring]]) -> tuple[float, float, float, float]:
    xs = [p[0] for s in shapes for r in s for p in r]
    ys = [p[1] for s in shapes for r in s for p in r]
    return min(xs), min(ys), max(xs), max(ys)


def moved(shapes: list[list[Ring]], f) -> list[list[Ring]]:
    return [[[f(*p) for p in r] for r in s] for s in shapes]


def edges(spark: SparkSession, shapes: list[list[Ring]], transform: Affine) -> DataFrame:
    """poly, x1, y1, x2, y2: all segments in pixel coordinates, where lines stay lines under any affine transform."""
    inverse = transform.inverse()
    rows = []
    for k, s in enumerate(shapes):
        for ring in s:
            points = [inverse.point(*p) for p in ring]
            rows += [(k, *map(float, a), *map(float, b)) for a, b in zip(points, points[1:], strict=False)]
    return spark.createDataFrame(rows, "poly int, x1 double, y1 double, x2 double, y2 double")


def covered_rows(lines: DataFrame, height: int, all_touched: bool) -> DataFrame:
    """row, spans: per grid row the column intervals (from, to) inside any polygon.

    A pixel is inside if its centre is, by the parity of crossings; with ``all_touched`` also if a boundary passes through it.
    A row's crossings are few, so nothing grows with the grid but the number of rows.
    """
    last = F.lit(height - 1)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first = F.greatest(F.lit(0), F.ceil(low - 0.5)).cast("int")
    final = F.least(last, F.ceil(high - 0.5) - 1).cast("int")
    crossing = lines.where(final >= first).withColumn("row", F.explode(F.sequence(first, final)))
    y = F.col("row") + 0.5
    crossing = crossing.select("poly", "row", (F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("x"))
    xs = crossing.groupBy("poly", "row").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pairs = F.expr("transform(sequence(0, cast(size(xs) div 2 as int) - 1), i -> struct(cast(ceil(xs[2 * i] - 0.5) as int) as c0, cast(ceil(xs[2 * i + 1] - 0.5) - 1 as int) as c1))")
    inside = xs.where(F.size("xs") >= 2).select("row", pairs.alias("s"))
    if all_touched:
        first = F.greatest(F.lit(0), F.floor(low)).cast("int")
        final = F.least(last, F.floor(high)).cast("int")
        touch = lines.where(final >= first).withColumn("row", F.explode(F.sequence(first, final)))
        at = lambda y: F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.when(F.col("y2") != F.col("y1"), F.col("y2") - F.col("y1"))
        a, b = at(F.greatest(low, F.col("row").cast("double"))), at(F.least(high, F.col("row") + 1.0))
        flat = F.col("y1") == F.col("y2")
        left = F.when(flat, F.least("x1", "x2")).otherwise(F.least(a, b))
        right = F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest(a, b))
        inside = inside.unionByName(touch.select("row", F.array(F.struct(F.floor(left).cast("int").alias("c0"), F.floor(right).cast("int").alias("c1"))).alias("s")))
    return inside.groupBy("row").agg(F.flatten(F.collect_list("s")).alias("spans")).select(F.col("row").alias("__row"), "spans")


def within(col, spans):
    """Is a column number in any of a row's intervals? NULL spans: no."""
    return F.coalesce(F.exists(spans, lambda s: (s["c0"] <= col) & (col <= s["c1"])), F.lit(False))


def segments_meet(a: Iterable, b: Iterable) -> bool:
    """Do two polygon sets share a point? Driver code for single footprints."""
    a, b = list(a), list(b)
    lines = lambda shapes: [(p, q) for s in shapes for r in s for p, q in zip(r, r[1:], strict=False)]
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    on = lambda p, q, r: min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])
    for p, q in lines(a):
        for r, s in lines(b):
            d1, d2, d3, d4 = side(r, s, p), side(r, s, q), side(p, q, r), side(p, q, s)
            if (d1 > 0) != (d2 > 0) and (d3 > 0) != (d4 > 0) and d1 != d2 and d3 != d4:
                return True
            if (d1 == 0 and on(r, s, p)) or (d2 == 0 and on(r, s, q)) or (d3 == 0 and on(p, q, r)) or (d4 == 0 and on(p, q, s)):
                return True
    return holds(a, b[0][0][0]) or holds(b, a[0][0][0])


def holds(shapes: list[list[Ring]], point: tuple[float, float]) -> bool:
    x, y = point
    for s in shapes:
        n = 0
        for ring in s:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
                if (y1 <= y) != (y2 <= y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                    n += 1
        if n % 2:
            return True
    return False
