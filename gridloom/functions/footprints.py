"""Polygons in columns: GeoJSON texts as arrays of edges, exact tests between them, and joins by quad cells.

A polygon is an array of edges; whether a point lies inside follows from the parity of its edges, so holes need nothing of their
own. Whole degrees are divided into quad cells. A geometry is covered by the cells of one level, as fine as its size allows;
two geometries that meet have cells of which one holds the other. So each cell stands for itself and its ancestors, and an
equi-join on cells finds the pairs that may meet: no nested loop. Pairs are told apart by column expressions on their edges.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of cells (a level's cells are 360 / 2^level degrees wide), and how many of them a side may span.
LEVELS, SPAN = (0, 3, 6, 9, 12, 15), 6
_POLYGON = "array<array<array<double>>>"
_EDGES = "array<array<struct<x1:double,y1:double,x2:double,y2:double>>>"


def shapes(geometry: Column) -> Column:
    """The polygons of a GeoJSON text, each an array of edges; NULL where there is none.

    Polygons, multipolygons, and features and collections of them count; rings are closed, those of under three points drop out.
    """
    text = lambda path: F.get_json_object(geometry, path)
    one, listed = "struct<type:string,coordinates:string>", "array<struct<type:string,coordinates:string>>"
    kind = text("$.type")
    parts = (
        F.when(kind == "Feature", F.array(F.from_json(text("$.geometry"), one)))
        .when(kind == "FeatureCollection", F.transform(F.from_json(text("$.features"), f"array<struct<geometry:{one}>>"), lambda f: f["geometry"]))
        .when(kind == "GeometryCollection", F.from_json(text("$.geometries"), listed))
        .otherwise(F.array(F.from_json(geometry, one)))
    )
    none = F.expr(f"cast(array() as array<{_POLYGON}>)")
    polygons = F.flatten(F.transform(parts, lambda g: F.coalesce(F.when(g["type"] == "Polygon", F.array(F.from_json(g["coordinates"], _POLYGON))).when(g["type"] == "MultiPolygon", F.from_json(g["coordinates"], f"array<{_POLYGON}>")), none)))
    edge = lambda p, q: F.struct(p[0].alias("x1"), p[1].alias("y1"), q[0].alias("x2"), q[1].alias("y2"))
    ring = lambda r: F.when(F.size(r) < 3, F.expr(f"cast(array() as {_EDGES[6:-1]})")).otherwise(F.filter(F.zip_with(r, F.concat(F.slice(r, 2, F.size(r) - 1), F.slice(r, 1, 1)), edge), lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"])))
    edges = F.transform(polygons, lambda p: F.flatten(F.transform(p, ring)))
    kept = F.filter(edges, lambda p: F.size(p) > 0)
    return F.when(F.size(kept) > 0, kept)


def literal(rings: list) -> Column:
    """Polygons (lists of rings of points) as a constant of the same form."""
    edges = [[{"x1": a[0], "y1": a[1], "x2": b[0], "y2": b[1]} for ring in polygon for a, b in zip(ring, ring[1:], strict=False) if a != b] for polygon in rings]
    return F.from_json(F.lit(json.dumps(edges)), _EDGES)


def _side(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
    return (qx - px) * (ry - py) - (qy - py) * (rx - px)


def edges_meet(e: Any, f: Any) -> Column:
    """Do two edges share a point?"""
    p, q = (e["x1"], e["y1"]), (e["x2"], e["y2"])
    r, s = (f["x1"], f["y1"]), (f["x2"], f["y2"])
    d1, d2, d3, d4 = _side(*r, *s, *p), _side(*r, *s, *q), _side(*p, *q, *r), _side(*p, *q, *s)
    between = lambda a, b, c: (F.least(a[0], b[0]) <= c[0]) & (c[0] <= F.greatest(a[0], b[0])) & (F.least(a[1], b[1]) <= c[1]) & (c[1] <= F.greatest(a[1], b[1]))
    cross = ((d1 > 0) & (d2 < 0) | (d1 < 0) & (d2 > 0)) & ((d3 > 0) & (d4 < 0) | (d3 < 0) & (d4 > 0))
    return cross | (d1 == 0) & between(r, s, p) | (d2 == 0) & between(r, s, q) | (d3 == 0) & between(p, q, r) | (d4 == 0) & between(p, q, s)


def _holds(polygons: Column, x: Column, y: Column) -> Column:
    """Does a point lie inside any polygon?"""
    crossed = lambda e: ((e["y1"] <= y) != (e["y2"] <= y)) & (x < e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)))
    return F.exists(polygons, lambda p: F.size(F.filter(p, crossed)) % 2 == 1)


def meet(a: Column, b: Column) -> Column:
    """Do two sets of polygons share a point? Of each polygon of one a point inside the other's is enough."""
    crossing = F.exists(F.flatten(a), lambda e: F.exists(F.flatten(b), lambda f: edges_meet(e, f)))
    inside = F.exists(a, lambda p: _holds(b, p[0]["x1"], p[0]["y1"])) | F.exists(b, lambda p: _holds(a, p[0]["x1"], p[0]["y1"]))
    return F.coalesce(crossing | inside, F.lit(False))


def cells(polygons: Column) -> Column:
    """The cells that cover polygons, each with its ancestors: array of (cell, own)."""
    flat = F.flatten(polygons)
    low = lambda n: F.array_min(F.transform(flat, lambda e: F.least(e[f"{n}1"], e[f"{n}2"])))
    high = lambda n: F.array_max(F.transform(flat, lambda e: F.greatest(e[f"{n}1"], e[f"{n}2"])))
    box = F.struct(low("x").alias("x0"), high("x").alias("x1"), low("y").alias("y0"), high("y").alias("y1"))
    number = lambda v, level: F.floor((v + 180.0) * (2.0**level / 360.0))
    key = lambda level, i, j: F.lit(level).cast("long") * (1 << 50) + (i + (1 << 20)) * (1 << 24) + (j + (1 << 20))

    def of(b: Column, at: int) -> Column:
        level = LEVELS[at]
        pairs = F.flatten(F.transform(F.sequence(number(b["x0"], level), number(b["x1"], level)), lambda i: F.transform(F.sequence(number(b["y0"], level), number(b["y1"], level)), lambda j: F.struct(i.alias("i"), j.alias("j")))))
        own = F.transform(pairs, lambda p: F.struct(key(level, p["i"], p["j"]).alias("cell"), F.lit(True).alias("own")))

        def ancestors(up: int) -> Column:
            down = 2.0 ** (level - up)
            return F.array_distinct(F.transform(pairs, lambda p: F.struct(key(up, F.floor(p["i"] / down), F.floor(p["j"] / down)).alias("cell"), F.lit(False).alias("own"))))

        return F.concat(own, *[ancestors(up) for up in LEVELS[:at]])

    def chosen(b: Column) -> Column:
        wide, out = F.greatest(b["x1"] - b["x0"], b["y1"] - b["y0"]), None
        for at in range(len(LEVELS) - 1, 0, -1):
            fits = wide <= (SPAN - 1) * 360.0 / 2.0 ** LEVELS[at]
            out = F.when(fits, of(b, at)) if out is None else out.when(fits, of(b, at))
        return out.otherwise(of(b, 0))

    return F.element_at(F.transform(F.array(box), chosen), 1)


def meeting(items: DataFrame, areas: DataFrame, geometry: str = "geometry", area_geometry: str = "geometry") -> DataFrame:
    """Items with the areas that they meet, one row per pair; columns of areas are prefixed ``area_``.

    Footprints that repeat are compared once. Rows without a readable polygon meet nothing.
    """
    named = areas.select(*[F.col(c).alias(f"area_{c}") for c in areas.columns])
    sides = []
    for df, text in ((items, F.col(geometry)), (named, F.col(f"area_{area_geometry}"))):
        distinct = df.select(F.md5(text.cast("binary")).alias("g"), text.alias("t")).where("t is not null").groupBy("g").agg(F.any_value("t").alias("t"))
        sides.append(distinct.select("g", shapes(F.col("t")).alias("p")).where("p is not null"))
    covers = [s.select("g", F.explode(cells(F.col("p"))).alias("c")).select("g", "c.cell", "c.own") for s in sides]
    a, b = covers[0].toDF("a", "cell", "a_own"), covers[1].toDF("b", "cell", "b_own")
    near = a.join(b, "cell").where("a_own or b_own").select("a", "b").distinct()
    pairs = near.join(sides[0].toDF("a", "pa"), "a").join(sides[1].toDF("b", "pb"), "b").where(meet(F.col("pa"), F.col("pb"))).select("a", "b")
    keyed = lambda df, c, k: df.withColumn(k, F.md5(F.col(c).cast("binary")))
    pairs = pairs.toDF("__a", "__b")
    return keyed(items, geometry, "__a").join(pairs, "__a").join(keyed(named, f"area_{area_geometry}", "__b"), "__b").select(*items.columns, *named.columns)
