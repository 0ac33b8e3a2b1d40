"""Raster operations; importing this package binds them to Raster."""

from . import algebra, analysis, clip, indices, merge, normalize, reproject, resample, stats, viz  # noqa: F401
