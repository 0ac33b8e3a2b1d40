"""Scene catalogues: items as a DataFrame, searches as filters on it, loads as aligned windows of stored assets."""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Sequence
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from ..functions import footprints, geometry, projection
from ..operators.clip import box_window, window_of
from ..operators.reproject import warp_onto
from ..operators.resample import align_to
from ..raster import Raster
from .arrays import session
from .files import load_raster

#: Columns of an items table.
ITEMS = (
    "id string, collection string, bbox array<double>, geometry string, datetime string, start_datetime string, "
    "properties struct<platform:string,constellation:string,instruments:array<string>,`eo:cloud_cover`:double,`proj:epsg`:int>, "
    "assets map<string,struct<href:string,type:string,title:string,roles:array<string>>>"
)


def read_items(path: str, spark: SparkSession | None = None) -> DataFrame:
    """Items of recorded search pages (JSON feature collections), one row each."""
    spark = session(spark)
    prop = "struct<datetime:string,start_datetime:string,platform:string,constellation:string,instruments:array<string>,`eo:cloud_cover`:double,`proj:epsg`:int>"
    asset = "map<string,struct<href:string,type:string,title:string,roles:array<string>>>"
    feature = f"struct<id:string,collection:string,bbox:array<double>,geometry:string,properties:{prop},assets:{asset}>"
    pages = spark.read.text(path, wholetext=True).select(F.from_json("value", f"features array<{feature}>").alias("p"))
    f = pages.select(F.explode("p.features").alias("f")).select("f.*")
    keep = F.struct(*[F.col(f"properties.`{n}`").alias(n) for n in ("platform", "constellation", "instruments", "eo:cloud_cover", "proj:epsg")])
    return f.select("id", "collection", "bbox", "geometry", F.col("properties.datetime").alias("datetime"), F.col("properties.start_datetime").alias("start_datetime"), keep.alias("properties"), "assets")


def item_time():
    """An item's time: its datetime, else its start; NULL if neither parses. Times without a zone are UTC."""
    return F.coalesce(F.try_to_timestamp("datetime"), F.try_to_timestamp("start_datetime"))


def _box(bbox: Any) -> tuple[float, float, float, float]:
    box = tuple(float(v) for v in bbox)
    if len(box) != 4 or not all(map(math.isfinite, box)) or box[0] > box[2] or box[1] > box[3]:
        raise ValidationError("a bbox is (west, south, east, north), ordered")
    return box


def _instant(text: str | datetime, closing: bool) -> datetime:
    """A point in time; a closing date without a time of day includes that day."""
    if isinstance(text, datetime):
        return text if text.tzinfo else text.replace(tzinfo=timezone.utc)
    text = text.strip()
    if re.fullmatch(r"\d{4}", text):
        first = datetime(int(text), 1, 1, tzinfo=timezone.utc)
        return first.replace(year=first.year + 1) - timedelta(microseconds=1) if closing else first
    if re.fullmatch(r"\d{4}-\d{2}", text):
        first = datetime(int(text[:4]), int(text[5:]), 1, tzinfo=timezone.utc)
        return (first + timedelta(days=32)).replace(day=1) - timedelta(microseconds=1) if closing else first
    try:
        value = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError as error:
        raise ValidationError(f"{text!r} is no time") from error
    value = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
    return value + timedelta(days=1) - timedelta(microseconds=1) if closing and len(text) == 10 else value


def time_range(value: Any) -> tuple[datetime | None, datetime | None]:
    """(from, to) of an instant, a day, an interval "a/b" with ".." for an open end, or a pair."""
    ends = value.split("/") if isinstance(value, str) else list(value) if isinstance(value, (tuple, list)) else [value]
    if len(ends) == 1:
        return _instant(ends[0], False), _instant(ends[0], True)
    if len(ends) != 2:
        raise ValidationError("a time is an instant or an interval")
    low, high = (None if e in (None, "", "..") else _instant(e, k == 1) for k, e in enumerate(ends))
    if low and high and low > high:
        raise ValidationError("the interval runs backwards")
    return low, high


def stac_search(collection: str | Sequence[str], *, items: DataFrame, bbox: Any = None, intersects: Any = None, datetime: Any = None, cloud_cover: float | None = None, limit: int | None = None) -> SearchResult:
    """Items of collections that meet all conditions, oldest first, undated last. Arguments are checked before any job.

    ``limit`` caps the items in catalogue order (the newest first, ties by id) before they are sorted. Items that report no
    cloud cover don't meet a cloud condition.
    """
    names = [collection] if isinstance(collection, str) else list(collection or [])
    if not names or any(not isinstance(n, str) or not n.strip() for n in names):
        raise ValidationError("at least one collection name is needed")
    if bbox is not None and intersects is not None:
        raise ValidationError("bbox and intersects exclude each other")
    keep = F.col("collection").isin(*names)
    box = _box(bbox) if bbox is not None else None
    shapes = None
    if intersects is not None:
        shapes = geometry.polygons(intersects)
        source = geometry.declared_crs(intersects)
        if source and source != "EPSG:4326":
            shapes = geometry.moved(shapes, lambda x, y: projection.convert(source, "EPSG:4326", x, y))
        w, s, e, n = geometry.bounds(shapes)
        if w < -180 or e > 180 or s < -90 or n > 90:
            raise ValidationError("the geometry isn't in longitude and latitude")
    reach = box or (geometry.bounds(shapes) if shapes else None)
    if reach:
        b = F.col("bbox")
        keep = keep & (F.size(b) >= 4) & (b[0] <= reach[2]) & (b[2] >= reach[0]) & (b[1] <= reach[3]) & (b[3] >= reach[1])
    if datetime is not None:
        low, high = time_range(datetime)
        if low is not None:
            keep = keep & (F.col("ts") >= F.lit(low))
        if high is not None:
            keep = keep & (F.col("ts") <= F.lit(high))
    if cloud_cover is not None:
        if isinstance(cloud_cover, bool) or not 0 <= cloud_cover <= 100:
            raise ValidationError("cloud cover lies in [0, 100]")
        keep = keep & (F.col("properties.`eo:cloud_cover`") <= float(cloud_cover))
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 1):
        raise ValidationError("a limit is a positive whole number")
    found = items.withColumn("ts", item_time()).where(keep)
    if shapes is not None:
        found = _footprints_meet(found, shapes)
    if limit is not None:
        found = found.orderBy(F.col("ts").desc_nulls_last(), "id").limit(limit)
    return SearchResult(found, bbox=box, intersects=shapes)


def _footprints_meet(found: DataFrame, areas: list) -> DataFrame:
    """Items whose footprint meets the polygons, by column expressions; the bbox filter has run already."""
    return found.where(footprints.meet(footprints.shapes(F.col("geometry")), footprints.literal(areas)))


class SearchResult(Sequence):
    """Found items in time order. ``df`` is lazy; items come to the driver when they are asked for."""

    def __init__(self, df: DataFrame, *, bbox: Any = None, intersects: Any = None, rows: list[Row] | None = None):
        self.df = df.orderBy(F.col("ts").asc_nulls_last(), "id")
        self.bbox, self.intersects, self._rows = bbox, intersects, rows

    def _got(self) -> list[Row]:
        if self._rows is None:
            self._rows = self.df.collect()  # a search's hits, as the caller iterates over them
        return self._rows

    def __len__(self) -> int:
        return len(self._rows) if self._rows is not None else self.df.count()

    def __getitem__(self, k: Any) -> Any:
        if isinstance(k, slice) and self._rows is None and (k.stop or -1) >= 0 and (k.start or 0) >= 0:
            rows = self.df.limit(k.stop).collect()[slice(k.start, None, k.step)]  # no more than the slice's end
            return SearchResult(self.df, bbox=self.bbox, intersects=self.intersects, rows=rows)
        if isinstance(k, slice):
            return SearchResult(self.df, bbox=self.bbox, intersects=self.intersects, rows=self._got()[k])
        if self._rows is None and isinstance(k, int) and k >= 0:  # this one row, not every hit
            rows = self.df.offset(k).limit(1).collect()
            if not rows:
                raise IndexError(f"item {k} of {len(self)}")
            return Item(rows[0], self.bbox, self.intersects)
        return Item(self._got()[k], self.bbox, self.intersects)

    def __iter__(self):
        return (Item(r, self.bbox, self.intersects) for r in self._got())

    @property
    def timestamps(self) -> list[datetime | None]:
        if self._rows is None:  # the times alone, without footprints and assets
            return [r.ts for r in self.df.select("ts", "id").collect()]
        return [r.ts for r in self._rows]

    def __repr__(self) -> str:
        if self._rows is None:
            n, first, last = self.df.agg(F.count(F.lit(1)), F.min("ts"), F.max("ts")).first()
        else:
            times = [r.ts for r in self._rows if r.ts]
            n, first, last = len(self._rows), min(times, default=None), max(times, default=None)
        return f"SearchResult({n} items" + (f", {first:%Y-%m-%d} to {last:%Y-%m-%d})" if first else ")")


class Item:
    """One scene: its properties, and its assets as rasters."""

    def __init__(self, row: Row, search_bbox: Any = None, search_intersects: Any = None):
        self.item, self.search_bbox, self.search_intersects = row, search_bbox, search_intersects

    id = property(lambda self: self.item.id)
    collection = property(lambda self: self.item.collection)
    timestamp = property(lambda self: self.item.ts)
    properties = property(lambda self: self.item.properties.asDict() if self.item.properties else {})
    assets = property(lambda self: dict(self.item.assets or {}))
    asset_names = property(lambda self: sorted(self.item.assets or {}))
    bbox = property(lambda self: tuple(self.item.bbox) if self.item.bbox else None)
    cloud_cover = property(lambda self: self.properties.get("eo:cloud_cover"))

    def load(self, assets: str | Sequence[str], *, bbox: Any = None, crop: bool = True, mask: bool = False, resampling: Any = "nearest", spark: SparkSession | None = None) -> Raster:
        """Assets as the bands of one raster, on the first asset's grid, cut to the area of interest.

        The area is ``bbox``, else the search's, both in longitude and latitude. Only its window of each asset is read.
        ``mask`` sets pixels outside the search's outline to nodata: the declared value, else NaN, or 0 for integers.
        """
        names = [assets] if isinstance(assets, str) else list(assets)
        missing = [n for n in names if n not in self.assets]
        if not names or missing:
            raise ValidationError(f"unknown assets {missing}; there are {self.asset_names}" if missing else "at least one asset is needed")
        if mask and self.search_intersects is None:
            raise ValidationError("a mask needs a search by geometry")
        area = _box(bbox) if bbox is not None else self.search_bbox or (geometry.bounds(self.search_intersects) if self.search_intersects else None)
        first: Raster | None = None
        parts = []
        for n in names:
            r = load_raster(self.assets[n].href, spark=spark)
            known = r.band_names
            r.band_names = [n] if r.get_count() == 1 else [k or f"{n}_{i}" for i, k in enumerate(known, 1)]
            if first is not None and r.get_crs() != first.get_crs():  # another zone: only what the first grid covers is read
                held = r.band_names
                r = warp_onto(_near(r, first), first, resampling)
                r.band_names = held
            elif area is not None and crop:
                box = projection.convert_bounds("EPSG:4326", r.get_crs(), area) if r.get_crs() != "EPSG:4326" else area
                held = r.band_names
                r = window_of(r, *box_window(r, box, outward=True))
                r.band_names = held
            if first is None:
                first = r
            elif not first.meta.same_grid(r.meta):
                held = r.band_names
                r = align_to(r, first, resampling)
                r.band_names = held
            parts.append(r)
        out = first if len(parts) == 1 else first.stack(parts[1:], names=[b for p in parts for b in p.band_names])
        if mask:
            from .. import contract

            fill = out.meta.nodata if out.meta.nodata is not None else (0 if contract.is_integer(out.meta.dtype) else float("nan"))
            shapes = geometry.moved(self.search_intersects, lambda x, y: projection.convert("EPSG:4326", out.get_crs(), x, y)) if out.get_crs() != "EPSG:4326" else self.search_intersects
            held = out.band_names
            out = out.clip_raster_with_vector({"type": "MultiPolygon", "coordinates": shapes}, crop=False, nodata=fill)
            out.band_names = held
        return out.with_meta(timestamp=self.timestamp, attrs={"stac_item": self.id, "stac_collection": self.collection, "stac_assets": names})


def _near(r: Raster, first: Raster) -> Raster:
    """The window of a raster that another one's extent, in another CRS, may read."""
    x0, y0, x1, y1 = projection.convert_bounds(first.get_crs(), r.get_crs(), first.get_bounds())
    t = r.get_transform()
    more = 8 * max(abs(t.a) + abs(t.b), abs(t.d) + abs(t.e)) + 0.02 * max(x1 - x0, y1 - y0)
    try:
        return window_of(r, *box_window(r, (x0 - more, y0 - more, x1 + more, y1 + more), outward=True))
    except ValidationError:  # no pixel: nothing but nodata comes of it, whatever is read
        return window_of(r, 0, 0, 1, 1)


def items_table(rows: list[dict], spark: SparkSession | None = None) -> DataFrame:
    """Items from mappings on the driver (``geometry`` may be a mapping)."""
    spark = session(spark)
    schema = T._parse_datatype_string(ITEMS)
    full = []
    for r in rows:
        g = r.get("geometry")
        full.append({f.name: r.get(f.name) for f in schema.fields} | {"geometry": json.dumps(g) if isinstance(g, dict) else g, "assets": {k: {"href": os.fspath(v)} if not isinstance(v, dict) else v for k, v in (r.get("assets") or {}).items()}})
    return spark.createDataFrame(full, schema)
