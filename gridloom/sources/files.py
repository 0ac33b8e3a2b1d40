"""Stored rasters: Parquet tiles with their metadata and overviews, and GeoTIFF files.

A tile is a row with an array per band, so a pixel costs its value and no place. Folders are rows of tiles, sorted by column in
small row groups: a box read prunes both ways.
"""

from __future__ import annotations

import json
import os
from dataclasses import replace
from datetime import datetime
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import contract
from ..errors import BackendError
from ..meta import Affine, RasterMeta, clean_names
from ..operators import tiles
from ..raster import Raster, raster_op
from . import geotiff, ranges
from .arrays import session

#: Tiles of one row that a file holds, and bytes of a row group.
FOLDER_TILES, GROUP_BYTES = 64, 8 << 20


def _to_json(m: RasterMeta) -> str:
    nodata = "nan" if isinstance(m.nodata, float) and m.nodata != m.nodata else m.nodata
    return json.dumps({"height": m.height, "width": m.width, "dtype": m.dtype, "count": m.count, "transform": list(m.transform), "crs": m.crs, "nodata": nodata, "band_names": list(m.band_names), "timestamp": m.timestamp.isoformat() if m.timestamp else None, "attrs": m.attrs}, default=str)


def _from_json(text: str) -> RasterMeta:
    d = json.loads(text)
    d["transform"] = Affine.of(d["transform"])
    d["nodata"] = float("nan") if d["nodata"] == "nan" else d["nodata"]
    d["band_names"] = tuple(d["band_names"])
    d["timestamp"] = datetime.fromisoformat(d["timestamp"]) if d["timestamp"] else None
    return RasterMeta(**d)


@raster_op(preserve_none=True)
def save_raster(ds: Raster, path: str | os.PathLike, driver: str = "auto") -> None:
    """Writes ``path`` as a GeoTIFF ("GTiff", or a name that ends in .tif) or as Parquet tiles ("parquet").

    Tiles come with overviews, each of half the resolution of the one before, down to a few pixels. GeoTIFF blocks
    are encoded by tasks and copied behind one another by the driver.
    """
    path = os.fspath(path)
    tiff = driver.lower() in ("gtiff", "geotiff", "cog") or (driver == "auto" and path.lower().endswith((".tif", ".tiff")))
    if tiff:
        if ds.meta.dtype == "bool":
            raise BackendError("a GeoTIFF holds numbers")
        geotiff.write(ds.spark, path, ds.tiles(), ds.meta, tiles.TILE)
        return
    if driver not in ("auto", "parquet"):
        raise BackendError(f"unknown driver {driver!r}")
    m = ds.meta
    kinds, levels, at = [contract.storage(m.dtype)] * m.count, tiles.level_count(m.height, m.width), ["tile_row", "tile_col"]
    level0 = ds.tiles().withColumns({"tile_row": F.expr(f"row0 div {tiles.TILE}").cast("int"), "tile_col": F.expr(f"col0 div {tiles.TILE}").cast("int")})
    level0.repartition("tile_row", F.expr(f"tile_col div {FOLDER_TILES}")).sortWithinPartitions(*at).write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).partitionBy("tile_row").parquet(f"{path}/tiles")
    if levels:
        stored = ds.spark.read.schema(tiles.block_type(kinds)).parquet(f"{path}/tiles")
        tiles.overviews_of(stored, m.height, m.width, kinds, levels).write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).partitionBy("level").parquet(f"{path}/levels")
    ds.spark.createDataFrame([(_to_json(ds.meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_raster(path: str | os.PathLike, *, timestamp: datetime | None = None, attrs: dict | None = None, band_names: Any = None, spark: SparkSession | None = None) -> Raster:
    """A stored raster; no pixel is read. Given names replace the file's descriptions."""
    path, spark = os.fspath(path), session(spark)
    local = ranges.scheme(path) in ("", "file")
    reader = None
    if not ranges.exists(spark, path):
        raise FileNotFoundError(path)
    if path.lower().endswith((".tif", ".tiff")) or (local and os.path.isfile(ranges.local_path(path))):
        with ranges.open_ranges(path, spark) as source:
            header = geotiff.read_header(source)
        meta = header.meta
        if ranges.opens_in_tasks(path):
            spark.dataSource.register(geotiff.GeoTiffSource)
            spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # windows choose the blocks that are read
            df = spark.read.format("geotiff").option("header", geotiff.header_option(header)).load(path)
        else:
            df = geotiff.from_session(spark, path, header)
            reader = lambda *window: geotiff.from_session(spark, path, header, window)
    else:
        if local:
            folder = ranges.local_path(f"{path}/meta")
            with open(next(os.path.join(folder, n) for n in os.listdir(folder) if n.startswith("part-")), encoding="utf-8") as f:
                meta = _from_json(f.read())
        else:
            meta = _from_json(spark.read.text(f"{path}/meta", wholetext=True).first()[0])
        kinds = [contract.storage(meta.dtype)] * meta.count
        stored = spark.read.schema(tiles.block_type(kinds, "tile_row int, tile_col int, ")).parquet(f"{path}/tiles")
        df = tiles.pixels_of(stored, meta.count, "tile_row", "tile_col")
    changes: dict[str, Any] = {}
    if band_names is not None:
        changes["band_names"] = clean_names(band_names, meta.count)
    if timestamp is not None:
        changes["timestamp"] = timestamp
    if attrs:
        changes["attrs"] = attrs
    meta = replace(meta, **changes)
    if "tile_row" not in df.columns:
        out = Raster(meta, df, [contract.decode(F.col(f"b{i}"), meta.nodata, meta.dtype) for i in range(1, meta.count + 1)], path=path)
        out._reader = reader
        return out
    out = Raster(meta, df, path=path, tiled=True)
    out._levels = (tiles.level_count(meta.height, meta.width), tuple(range(1, meta.count + 1)))
    return out


def load_level(ds: Raster, level: int, bands: tuple[int, ...]) -> Raster:
    """Bands of a stored raster's overview; its pixels are 2^level times as wide."""
    m, kind = ds.meta, contract.storage(ds.meta.dtype)
    height, width = tiles.level_shape(m.height, m.width, level)
    names = ", ".join(f"b{i} array<{kind}>" for i in sorted(set(bands)))
    stored = ds.spark.read.schema(f"level int, tile_row int, tile_col int, row0 int, col0 int, h int, w int, {names}").parquet(f"{ds.path}/levels").where(F.col("level") == level)
    stored = stored.select("row0", "col0", "w", "tile_row", "tile_col", *[F.col(f"b{i}").alias(f"b{k}") for k, i in enumerate(bands, 1)])
    meta = replace(m, height=height, width=width, transform=m.transform.scaled(2**level, 2**level))
    return Raster(meta, tiles.pixels_of(stored, len(bands), "tile_row", "tile_col"), tiled=True)
