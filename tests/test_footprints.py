"""Footprints in columns and by cells, against the driver's own test."""

import json
import random

from pyspark.sql import functions as F

from gridloom.functions import footprints, geometry


def shape(r, wide):
    x, y, w = r.uniform(-170, 160), r.uniform(-80, 70), wide * r.random() + 0.001
    ring = [[x, y], [x + w, y + w * r.random()], [x + w * r.random(), y + w], [x, y]]
    if r.random() < 0.3:  # a box with a hole
        ring = [[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]
        hole = [[x + w / 4, y + w / 4], [x + w / 2, y + w / 4], [x + w / 2, y + w / 2], [x + w / 4, y + w / 2]]
        return {"type": "Polygon", "coordinates": [ring, hole]}
    if r.random() < 0.3:
        return {"type": "MultiPolygon", "coordinates": [[ring], [[[x + 2 * w, y], [x + 3 * w, y], [x + 3 * w, y + w], [x + 2 * w, y]]]]}
    return {"type": "Polygon", "coordinates": [ring]}


def test_cells_find_all_pairs(spark):
    r = random.Random(2)
    items = [(i, json.dumps(shape(r, r.choice([0.5, 5, 40])))) for i in range(120)]
    items += [(200, items[0][1]), (201, None), (202, "no json"), (203, '{"type": "Point", "coordinates": [1, 2]}'), (204, '{"type": "Polygon"}'), (205, json.dumps({"type": "Feature", "geometry": json.loads(items[1][1])})), (206, json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": json.loads(items[2][1])}]})), (207, json.dumps({"type": "GeometryCollection", "geometries": [json.loads(items[3][1])]})), (None, items[4][1])]
    areas = [(i, json.dumps(shape(r, r.choice([0.1, 10, 100]))), "x") for i in range(90)] + [(100, None, "y"), (101, items[5][1], "z"), (101, items[5][1], "z")]
    a = spark.createDataFrame(items, "id long, geometry string").withColumn("area", F.lit(1))
    b = spark.createDataFrame(areas, "id long, geometry string, area string")
    got = sorted(((x.id, x.area_id) for x in footprints.meeting(a, b).collect()), key=str)
    parsed = lambda t: geometry.polygons(t) if t and t.startswith("{") and "Point" not in t and "coordinates" in t else None
    want = sorted(((i, j) for i, s in items for j, t, _ in areas if parsed(s) and parsed(t) and (geometry.segments_meet(parsed(s), parsed(t)) or any(geometry.holds(parsed(t), p[0][0]) for p in parsed(s)) or any(geometry.holds(parsed(s), p[0][0]) for p in parsed(t)))), key=str)
    assert got == want and len(got) > 150
    assert footprints.meeting(a.limit(0), b).count() == footprints.meeting(a, b.limit(0)).count() == 0
    plan = footprints.meeting(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_touching_and_nested(spark):
    box = lambda x, y, w: {"type": "Polygon", "coordinates": [[[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]]}
    ring = {"type": "Polygon", "coordinates": [box(0, 0, 10)["coordinates"][0], box(2, 2, 6)["coordinates"][0]]}
    cases = [(box(0, 0, 1), box(1, 1, 1), True), (box(0, 0, 1), box(1.01, 0, 1), False), (box(0, 0, 10), box(2, 2, 1), True), (ring, box(4, 4, 1), False), (ring, box(1, 1, 8), True), (box(0, 0, 1), box(0, 0, 1), True)]
    df = spark.createDataFrame([(json.dumps(a), json.dumps(b)) for a, b, _ in cases], "a string, b string")
    got = [r.m for r in df.select(footprints.meet(footprints.shapes(F.col("a")), footprints.shapes(F.col("b"))).alias("m")).collect()]
    assert got == [m for *_, m in cases]
    one = spark.createDataFrame([(json.dumps(b),) for _, b, _ in cases[:3]], "b string")
    assert [r.m for r in one.select(footprints.meet(footprints.shapes(F.col("b")), footprints.literal(geometry.polygons(cases[0][0]))).alias("m")).collect()] == [True, False, False]
