"""Queries against their SQL on small tables that once told them apart."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import Raster, RasterMeta, ValidationError
from gridloom.operators import reproject, viz, warp
from gridloom.plans import QUERIES, SQL
from gridloom.plans.queries import rounded

duckdb = pytest.importorskip("duckdb")


def sql_rows(folder, query, *tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return sorted(c.execute(query).fetchall())


def test_composite_has_every_pixel(spark, tmp_path, monkeypatch):
    """However small the figure; the green band's values are 8640ths, of which some lie halfway between five-digit numbers."""
    n, k = 3000, F.col("event_id")
    user = F.when(k < 300, 0).when(k < 2700, (k - 300) * 3 + 780).otherwise(8640)
    kind = F.when(k % 11 == 0, "error").otherwise("view")
    spark.range(n).select(F.col("id").alias("event_id")).select(k, F.lit(datetime.datetime(2024, 1, 1)).alias("ts"), user.cast("long").alias("user_id"), kind.alias("event_type"), (k * 7919 % 1000 / 8).alias("value"), F.format_string('{"k": %s}', k % 97).alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(viz, "OVERSAMPLING", 0.005)  # a figure of 12 pixels
    got = sorted(map(tuple, QUERIES["composite_rgb"](spark, str(tmp_path)).collect()), key=lambda x: x[:2])
    want = sorted(sql_rows(tmp_path, SQL["composite_rgb"], "events"), key=lambda x: x[:2])
    assert len(got) == n and got == want
    assert any(x[3] == 0.12812 for x in got)  # 1107 / 8640


def test_composite_without_stretch(raster):
    r = raster([[[1.0, 2.0]], [[3.0, -9999.0]], [[5.0, 6.0]]], nodata=-9999)
    assert sorted(map(tuple, viz.composite(r, [3, 2, 1], stretch=False).collect())) == [(0, 0, 5.0, 3.0, 1.0, 1.0), (0, 1, 6.0, None, 2.0, 0.0)]
    with pytest.raises(ValidationError):
        viz.composite(r, [1, 2])


def test_rounding_is_that_of_the_sql(spark):
    values = [0.128125, 0.071875, 2.5e-6, -2.5e-6, 1.0000005, -0.128125, 1e300, 123456.1234565, 0.5, None, float("inf")]
    got = [x[0] for x in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(rounded("v", 5)).collect()]
    want = [duckdb.connect().execute("SELECT CAST(round(CAST(? AS DOUBLE), 5) AS DOUBLE)", [v]).fetchall()[0][0] for v in values]
    assert got == want


def test_nearest_reprojection_is_exact(spark, tmp_path):
    """600 rows of 0.01 degrees: Mercator's places bend by more than an edge of a pixel allows."""
    k = F.col("c_custkey")
    spark.range(30000).select(F.col("id").alias("c_custkey")).select(k, (k * 7919 % 30011).cast("double").alias("c_acctbal"), (k % 25).cast("int").alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    got = sorted(map(tuple, QUERIES["reproject_3857"](spark, str(tmp_path)).collect()), key=lambda x: x[:2])
    want = sorted(sql_rows(tmp_path, SQL["reproject_3857"], "customer"), key=lambda x: x[:2])
    assert len(got) > 20000 and got == want


@pytest.mark.parametrize("tolerance", [0.125, 7.5])
def test_nearest_is_exact_at_any_tolerance(spark, monkeypatch, tolerance):
    """What a tile is sent covers its exact places, however rough the grid that it was sent by."""
    meta = RasterMeta(90, 80, "float64", 1, (9000.0, 0, 200000.0, 0, -9000.0, 7800000.0), "EPSG:32633", float("nan"))
    i = F.col("id")
    table = spark.range(90 * 80).select(F.expr("cast(id div 80 as int)").alias("row"), (i % 80).cast("int").alias("col"), i.cast("double").alias("b1"))
    monkeypatch.setattr(warp, "tile_side", lambda t: 16)
    r = Raster.from_table(table, meta)
    h, w, to = reproject.target_grid(r, "EPSG:4326")
    got = np.full((h, w), np.nan)
    for x in reproject.warp(r, h, w, to, "EPSG:4326", "nearest", tolerance).where("b1 is not null").collect():
        got[x["row"], x["col"]] = x["b1"]
    u, v = warp.Transformer(meta, h, w, to, "EPSG:4326").exact(*np.meshgrid(np.arange(w) + 0.5, np.arange(h) + 0.5))
    inside = (u >= 0) & (u < 80) & (v >= 0) & (v < 90)
    np.testing.assert_array_equal(got, np.where(inside, np.floor(v) * 80 + np.floor(u), math.nan))
