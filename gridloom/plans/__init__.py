"""Registered queries: rasters over the driver's tables, with the SQL that gives the same rows."""

from . import geography, scenes  # noqa: F401  they register their queries
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
