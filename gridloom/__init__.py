"""gridloom: gridded Earth observation data as lazy Spark plans."""

__version__ = "0.1.0"

from . import operators
from ._optional import show_versions
from .errors import AlignmentError, BackendError, CRSMismatchError, DatasetError, GridError, MissingDependencyError, ValidationError
from .meta import Affine, RasterMeta
from .operators.algebra import absolute, add, divide, multiply, power, sqrt, subtract
from .operators.algebra import log_ as log
from .operators.analysis import aspect, hillshade, slope, time_composite
from .operators.clip import clip_raster_with_bbox, clip_raster_with_vector
from .operators.indices import evi, ndbi, ndmi, ndvi, ndwi, normalized_difference, savi
from .operators.merge import mosaic, stack
from .operators.normalize import normalize_min_max, normalize_percentile, standardize
from .operators.reproject import reproject_raster
from .operators.resample import Resampling, resample
from .operators.stats import describe, extract_value_at_coordinate, get_maximum_pixel, get_mean_pixel, get_minimum_pixel, get_percentile_pixel
from .operators.viz import composite, plot_band_array, plot_composite, plot_histogram, plot_raster, plot_raster_with_histogram
from .raster import OPERATIONS, Raster, raster_op, raster_viz
from .sources import from_labelled, from_xarray, load_array, load_raster, load_sample_dataset, stac_search, to_labelled

Raster.from_path = staticmethod(load_raster)
Raster.from_array = staticmethod(load_array)

__all__ = [
    "OPERATIONS", "Affine", "AlignmentError", "BackendError", "CRSMismatchError", "DatasetError", "GridError", "MissingDependencyError", "Raster", "RasterMeta", "Resampling", "ValidationError",
    "absolute", "add", "aspect", "clip_raster_with_bbox", "clip_raster_with_vector", "composite", "describe", "divide", "evi", "extract_value_at_coordinate", "from_labelled", "from_xarray", "get_maximum_pixel", "get_mean_pixel",
    "get_minimum_pixel", "get_percentile_pixel", "hillshade", "load_array", "load_raster", "load_sample_dataset", "log", "mosaic", "multiply", "ndbi", "ndmi", "ndvi", "ndwi", "normalize_min_max", "normalize_percentile",
    "normalized_difference", "operators", "plot_band_array", "plot_composite", "plot_histogram", "plot_raster", "plot_raster_with_histogram", "power", "raster_op", "raster_viz", "reproject_raster", "resample", "savi",
    "show_versions", "slope", "sqrt", "stac_search", "stack", "standardize", "subtract", "time_composite", "to_labelled",
]
