"""The test tables as grids: a dense key k is the pixel (k div width, k mod width)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..meta import Affine, RasterMeta
from ..raster import Raster

#: The grids' place: 10 m pixels in UTM zone 33 north.
PLACE = Affine.from_origin(500000.0, 4200000.0, 10.0, 10.0)
CRS = "EPSG:32633"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(df: DataFrame, key: str, width: int, bands: list[Column], dtype: str, nodata: float | None = None, names: tuple = (), transform: Affine = PLACE, crs: str = CRS, height: int | None = None) -> Raster:
    height = height or -(-df.count() // width)  # from the files' footers
    meta = RasterMeta(height, width, dtype, len(bands), transform, crs, nodata, names)
    return Raster.from_table(df, meta, bands, key=key)


def events(spark: SparkSession, d: str, **options) -> Raster:
    """Value, user and k of events; errors are nodata."""
    ok = F.col("event_type") != "error"
    bands = [F.when(ok, F.col("value").cast("float")), F.when(ok, F.col("user_id").cast("float")), F.when(ok, F.regexp_extract("props", r"(\d+)", 1).cast("float"))]
    return grid(table(spark, d, "events"), "event_id", 100, bands, "float32", -9999.0, ("nir", "red", "blue"), **options)


def orders(spark: SparkSession, d: str, **options) -> Raster:
    """Price and customer of orders; pending ones are nodata."""
    ok = F.col("o_orderstatus") != "P"
    return grid(table(spark, d, "orders"), "o_orderkey", 100, [F.when(ok, F.col("o_totalprice").cast("float")), F.when(ok, F.col("o_custkey").cast("float"))], "float32", -9999.0, **options)


def part_sizes(spark: SparkSession, d: str) -> Raster:
    return grid(table(spark, d, "part"), "p_partkey", 20, [F.col("p_size")], "uint8")


def part_prices(spark: SparkSession, d: str) -> Raster:
    return grid(table(spark, d, "part"), "p_partkey", 20, [F.col("p_retailprice")], "float32")


def balances(spark: SparkSession, d: str, **options) -> Raster:
    return grid(table(spark, d, "customer"), "c_custkey", 50, [F.col("c_acctbal")], "float32", **options)


def nations(spark: SparkSession, d: str) -> Raster:
    return grid(table(spark, d, "customer"), "c_custkey", 50, [F.col("c_nationkey")], "int32")


def scene_items(spark: SparkSession, d: str) -> DataFrame:
    """Orders as catalogue items."""
    o = table(spark, d, "orders")
    lon, lat = (F.col("o_custkey") % 340 - 170).cast("double"), (F.col("o_orderkey") % 160 - 80).cast("double")
    when = F.when(F.col("o_orderkey") % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    start = F.when(F.col("o_orderkey") % 14 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    n = F.lit(None).cast("string")
    props = F.struct(n.alias("platform"), n.alias("constellation"), F.lit(None).cast("array<string>").alias("instruments"), F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_custkey") % 101).cast("double")).alias("eo:cloud_cover"), F.lit(32633).alias("proj:epsg"))
    ring = F.format_string('{"type": "Polygon", "coordinates": [[[%s, %s], [%s, %s], [%s, %s], [%s, %s]]]}', lon, lat, lon + 1, lat, lon, lat + 1, lon, lat)
    assets = F.lit(None).cast("map<string,struct<href:string,type:string,title:string,roles:array<string>>>")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("collection"), F.array(lon, lat, lon + 1, lat + 1).alias("bbox"), ring.alias("geometry"), when.alias("datetime"), start.alias("start_datetime"), props.alias("properties"), assets.alias("assets"))
