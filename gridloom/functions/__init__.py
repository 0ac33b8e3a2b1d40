"""Geometry and map projection helpers, as driver code and as Spark columns."""
