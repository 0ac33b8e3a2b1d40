"""Exceptions of the engine."""


class GridError(Exception):
    """Base of all errors raised on purpose."""


class ValidationError(GridError, ValueError):
    """An argument or a raster doesn't fit the operation."""


class CRSMismatchError(GridError, ValueError):
    """Rasters lie in different coordinate reference systems."""


class AlignmentError(GridError, ValueError):
    """Rasters lie on different grids."""


class BackendError(GridError, RuntimeError):
    """Reading, warping or writing failed."""


class MissingDependencyError(GridError, ImportError):
    """An optional package is needed."""


class DatasetError(GridError, RuntimeError):
    """A sample file is missing or damaged."""
