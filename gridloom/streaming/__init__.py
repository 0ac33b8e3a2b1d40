"""Streams of pixel observations."""

from .composites import pixel_stream, windowed_composite

__all__ = ["pixel_stream", "windowed_composite"]
