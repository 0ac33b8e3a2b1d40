"""Where rasters and scene items come from and go to."""

from .arrays import load_array
from .catalogue import Item, SearchResult, stac_search
from .files import load_raster, save_raster
from .labelled import from_labelled, from_xarray, to_labelled, to_xarray
from .samples import SampleFile, ensure_asset, load_sample_dataset
from .vectors import read_vectors

__all__ = ["Item", "SampleFile", "SearchResult", "ensure_asset", "from_labelled", "from_xarray", "load_array", "load_raster", "load_sample_dataset", "read_vectors", "save_raster", "stac_search", "to_labelled", "to_xarray"]
