"""Rasters from arrays on the driver."""

from __future__ import annotations

from datetime import datetime
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from ..errors import ValidationError
from ..meta import STORAGE, Affine, RasterMeta
from ..raster import Raster


def session(spark: SparkSession | None = None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def load_array(array: Any, *, transform: Any = None, crs: Any = None, nodata: float | None = None, timestamp: datetime | None = None, attrs: dict | None = None, band_names: Any = None, spark: SparkSession | None = None) -> Raster:
    """A raster of a (row, col) or (band, row, col) array."""
    if not isinstance(array, np.ndarray) or array.ndim not in (2, 3):
        raise ValidationError("an array of two or three dimensions is needed")
    array = array[None] if array.ndim == 2 else array
    if array.dtype.name not in STORAGE:
        raise ValidationError(f"unsupported pixel type {array.dtype}")
    count, height, width = array.shape
    meta = RasterMeta(height, width, array.dtype.name, count, Affine.of(transform) if transform is not None else Affine(), crs, nodata, band_names or (), timestamp, attrs or {})
    rows, cols = np.indices((height, width), np.int32)
    kinds = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_()}
    kind = kinds[STORAGE[meta.dtype]]
    columns = {"row": pa.array(rows.ravel()), "col": pa.array(cols.ravel())}
    for i in range(count):
        columns[f"b{i + 1}"] = pa.array(np.ascontiguousarray(array[i]).ravel()).cast(kind)
    return Raster.from_table(session(spark).createDataFrame(pa.table(columns)), meta)
