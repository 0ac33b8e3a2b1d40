"""Queries over scenes and time: as-of joins, footprints and many areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import footprints
from ..operators.asof import as_of
from . import grids
from .queries import query, r6, rounded

#: Orders ask for their pixel, 60 days after they were placed, what was last shipped there within 30 days.
_SEEN = "seen AS (SELECT l_orderkey % 997 AS k, CAST(l_shipdate AS TIMESTAMP) AS t, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"
_ASKED = "asked AS (SELECT o_orderkey AS id, o_orderkey % 997 AS k, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 60 DAY AS t FROM orders)"


def _tables(spark, d):
    line, orders = grids.table(spark, d, "lineitem"), grids.table(spark, d, "orders")
    place = lambda c: [F.expr(f"cast(({c} % 997) div 50 as int)").alias("row"), F.expr(f"cast(({c} % 997) % 50 as int)").alias("col")]
    seen = line.select(*place("l_orderkey"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_quantity").alias("q"))
    asked = orders.select(F.col("o_orderkey").alias("id"), *place("o_orderkey"), (F.col("o_orderdate").cast("timestamp") + F.expr("interval 60 days")).alias("ts"))
    return asked, seen


@query(f"WITH {_SEEN}, {_ASKED} SELECT id, CASE WHEN a.t - s.t <= INTERVAL 30 DAY THEN {r6('s.q')} END AS q, CASE WHEN a.t - s.t <= INTERVAL 30 DAY THEN strftime(s.t, '%Y-%m-%d') END AS day FROM asked a ASOF LEFT JOIN seen s ON a.k = s.k AND a.t >= s.t")
def as_of_latest(spark, d):
    """Of each pixel and date the latest observation of the 30 days before."""
    out = as_of(*_tables(spark, d), ["q"], tolerance=30 * 86400)
    return out.select("id", rounded("q").alias("q"), F.date_format("seen_at", "yyyy-MM-dd").alias("day"))


@query(
    f"""WITH {_SEEN}, {_ASKED}, b AS (SELECT id, a.t, s.t AS bt, s.q AS bq FROM asked a ASOF LEFT JOIN seen s ON a.k = s.k AND a.t >= s.t), n AS (SELECT id, s.t AS nt, s.q AS nq FROM asked a ASOF LEFT JOIN seen s ON a.k = s.k AND a.t <= s.t),
j AS (SELECT b.id, CASE WHEN bt IS NULL OR nt - b.t < b.t - bt THEN nt ELSE bt END AS st, CASE WHEN bt IS NULL OR nt - b.t < b.t - bt THEN nq ELSE bq END AS q FROM b JOIN n USING (id)) SELECT id, {r6('q')} AS q, strftime(st, '%Y-%m-%d') AS day FROM j"""
)
def as_of_nearest(spark, d):
    """Of each pixel and date the nearest observation, before or after."""
    out = as_of(*_tables(spark, d), ["q"], direction="nearest")
    return out.select("id", rounded("q").alias("q"), F.date_format("seen_at", "yyyy-MM-dd").alias("day"))


# -- many areas: a box for every supplier --

_BOX = "box AS (SELECT s_suppkey AS id, CAST(s_suppkey * 37 % 330 - 165 AS DOUBLE) + 0.25 AS x0, CAST(s_suppkey * 53 % 150 - 75 AS DOUBLE) + 0.25 AS y0, (s_suppkey % 7 + 1) * 0.75 AS w FROM supplier)"


@query(
    f"""WITH {_BOX}, t AS (SELECT o_orderkey AS k, CAST(o_custkey % 340 - 170 AS DOUBLE) AS x, CAST(o_orderkey % 160 - 80 AS DOUBLE) AS y FROM orders)
SELECT id, count(*) AS n, min(k) AS first FROM box JOIN t ON x <= x0 + w AND x + 1 >= x0 AND y <= y0 + w AND y + 1 >= y0 AND greatest(x0, x) - x + greatest(y0, y) - y <= 1 GROUP BY 1"""
)
def items_in_areas(spark, d):
    """How many scenes meet each of many areas: footprints and areas joined by quad cells."""
    k = F.col("s_suppkey")
    x, y, w = (k * 37 % 330 - 165).cast("double") + 0.25, (k * 53 % 150 - 75).cast("double") + 0.25, (k % 7 + 1) * 0.75
    ring = F.format_string('{"type": "Polygon", "coordinates": [[[%s, %s], [%s, %s], [%s, %s], [%s, %s], [%s, %s]]]}', x, y, x + w, y, x + w, y + w, x, y + w, x, y)
    areas = grids.table(spark, d, "supplier").select(k.alias("id"), ring.alias("geometry"))
    items = grids.scene_items(spark, d).select(F.col("id").cast("long").alias("k"), "geometry")
    return footprints.meeting(items, areas).groupBy(F.col("area_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"))
