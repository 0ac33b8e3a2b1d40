"""Warping by an approximated transformer, tile by tile.

A target tile knows where its pixels lie in the source from a control grid: exact transforms at its nodes, straight lines between
them. The grid is halved until it errs by less than half the tolerance wherever that is measured, and becomes exact where it
must (at poles, at the antimeridian). A source tile works out, from the same grids, which target tiles read it, and sends each
the rectangle it reads. So tables never meet by a join: source pixels travel once, as arrays, to the tiles that need them.
The nearest method draws at exact places, as any error across an edge picks another pixel; the grid only tells it what to read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import contract
from ..functions import projection
from ..functions.crs import definition
from ..meta import Affine, RasterMeta
from ..raster import Raster
from . import tiles
from .resample import SUPPORT, rounded, weights
from .tiles import Block

#: The largest error of a place, in source pixels.
TOLERANCE = 0.125
#: Points along a side of a source tile whose places in the target are looked at.
PROBES = 17
#: Control grids that a task remembers.
HELD_GRIDS = 4096


@dataclass
class Transformer:
    """From target pixels to source pixels, and back."""

    source: RasterMeta
    height: int
    width: int
    transform: Affine
    crs: str | None
    tolerance: float = TOLERANCE
    known: dict = field(default_factory=dict, repr=False)

    def exact(self, col: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source columns and rows of places in the target, both in pixels."""
        t, i = self.transform, self.source.transform.inverse()
        x, y = t.a * col + t.b * row + t.c, t.d * col + t.e * row + t.f
        if self.crs != self.source.crs:
            x, y = projection.convert_arrays(self.crs, self.source.crs, x, y)
            x = _turned(x, self.source.crs, self.source.bounds)
        with np.errstate(all="ignore"):
            return i.a * x + i.b * y + i.c, i.d * x + i.e * y + i.f

    def forward(self, col: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Target columns and rows of places in the source."""
        t, i = self.source.transform, self.transform.inverse()
        x, y = t.a * col + t.b * row + t.c, t.d * col + t.e * row + t.f
        if self.crs != self.source.crs:
            x, y = projection.convert_arrays(self.source.crs, self.crs, x, y)
            x = _turned(x, self.crs, RasterMeta(self.height, self.width, "float32", 1, self.transform).bounds)
        with np.errstate(all="ignore"):
            return i.a * x + i.b * y + i.c, i.d * x + i.e * y + i.f

    def _nodes(self, r0: int, r1: int, c0: int, c1: int, down: int, across: int) -> np.ndarray:
        rows, cols = np.linspace(r0 + 0.5, r1 - 0.5, down + 1), np.linspace(c0 + 0.5, c1 - 0.5, across + 1)
        return np.stack(self.exact(*np.meshgrid(cols, rows)))

    def grid(self, r0: int, r1: int, c0: int, c1: int) -> np.ndarray:
        """The control grid of a rectangle of the target: (u and v, rows of nodes, columns of nodes)."""
        key = (r0, r1, c0, c1)
        if key in self.known:
            return self.known[key]
        n, most = 1, (r1 - r0 - 1, c1 - c0 - 1)
        now = self._nodes(*key, 1, 1)
        while n < max(most):
            finer = self._nodes(*key, 2 * n, 2 * n)
            guess = _lines(now, 2 * n + 1, 2 * n + 1)
            error = np.hypot(*(finer - guess))
            if np.isfinite(error).all() and error.max() <= self.tolerance / 2:
                break
            n, now = 2 * n, finer
        else:
            if max(most) > 0:
                now = self._nodes(*key, max(most[0], 1), max(most[1], 1))  # a node for every pixel
        if len(self.known) >= HELD_GRIDS:
            self.known.clear()
        self.known[key] = now
        return now

    def places(self, r0: int, r1: int, c0: int, c1: int) -> np.ndarray:
        """u and v of every pixel's centre in a rectangle of the target."""
        return _lines(self.grid(r0, r1, c0, c1), r1 - r0, c1 - c0)

    def exact_places(self, r0: int, r1: int, c0: int, c1: int) -> np.ndarray:
        """The same without an error."""
        return np.stack(self.exact(*np.meshgrid(np.arange(c0, c1) + 0.5, np.arange(r0, r1) + 0.5)))


def _turned(x: np.ndarray, crs: str | None, box: tuple[float, float, float, float]) -> np.ndarray:
    """Longitudes as a grid of that extent counts them: within half a turn of its middle."""
    if not definition(crs).geographic:
        return x
    with np.errstate(invalid="ignore"):
        return x - 360.0 * np.floor((x - (box[0] + box[2]) / 2 + 180.0) / 360.0)


def _lines(nodes: np.ndarray, height: int, width: int) -> np.ndarray:
    """Nodes' values between them, along straight lines, at height x width evenly spaced places from the first to the last."""

    def matrix(n: int, k: int) -> np.ndarray:
        at = np.linspace(0.0, k - 1, n) if n > 1 else np.zeros(1)
        low = np.minimum(at.astype(int), k - 2)
        out = np.zeros((n, k))
        out[np.arange(n), low] = 1 - (at - low)
        out[np.arange(n), low + 1] += at - low
        return out

    if nodes.shape[1:] == (height, width):
        return nodes
    if not np.isfinite(nodes).all():  # zero times infinity would spread over whole rows
        i, j = (np.rint(np.linspace(0, k - 1, n)).astype(int) for n, k in ((height, nodes.shape[1]), (width, nodes.shape[2])))
        return nodes[:, i][:, :, j]
    return matrix(height, nodes.shape[1]) @ nodes @ matrix(width, nodes.shape[2]).T


def tile_side(t: Transformer) -> int:
    """Target tiles are smaller where a target pixel spans many source pixels, so that what a tile reads stays bounded."""
    probe = np.linspace(0.05, 0.95, 9)
    col, row = np.meshgrid(probe * t.width, probe * t.height)
    spans = [np.hypot(a - b, c - d) for (a, c), (b, d) in ((t.exact(col + 0.5, row), t.exact(col - 0.5, row)), (t.exact(col, row + 0.5), t.exact(col, row - 0.5)))]
    scale = np.concatenate([s[np.isfinite(s)] for s in spans] or [np.ones(1)])
    wide = float(np.quantile(scale, 0.9)) if len(scale) else 1.0
    return int(min(tiles.TILE, max(8, 2 ** int(math.log2(max(8.0, 2 * tiles.TILE / max(wide, 1e-9)))))))


def warped(ds: Raster, height: int, width: int, transform: Affine, crs: str | None, method: str, tolerance: float = TOLERANCE) -> DataFrame:
    """row, col, b1 ... of every pixel of a target grid, NULL where the source doesn't reach; nearest or a kernel method."""
    m, t = ds.meta, Transformer(ds.meta, height, width, transform, crs, tolerance)
    side, count, kinds = tile_side(t), ds.meta.count, [contract.storage(ds.meta.dtype)] * ds.meta.count
    reach = 1 + math.ceil(tolerance) if method == "nearest" else SUPPORT[method] + 1  # exact places, but pieces sent by the grid's
    across, size = -(-width // side), (m.height, m.width)

    def box(tr: int, tc: int) -> tuple[int, int, int, int]:
        return tr * side, min(height, (tr + 1) * side), tc * side, min(width, (tc + 1) * side)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tiles.unpacked(batch, count):
                (h, w), edge = b.shape, reach + 1
                rows, cols = np.linspace(b.row0 - edge, b.row0 + h + edge, PROBES), np.linspace(b.col0 - edge, b.col0 + w + edge, PROBES)
                x, y = t.forward(*np.meshgrid(cols, rows))
                if not np.isfinite(x + y).any():
                    continue
                (lo_c, hi_c), (lo_r, hi_r) = _bounds(x, side), _bounds(y, side)
                for tr in range(max(0, lo_r), min(-(-height // side), hi_r + 1)):
                    for tc in range(max(0, lo_c), min(across, hi_c + 1)):
                        u, v = t.grid(*box(tr, tc))
                        read = np.isfinite(u) & np.isfinite(v)
                        if not read.any():
                            continue
                        r0, r1, c0, c1 = math.floor(v[read].min()) - edge, math.ceil(v[read].max()) + edge, math.floor(u[read].min()) - edge, math.ceil(u[read].max()) + edge
                        piece = b.part(r0, r1, c0, c1)
                        if piece.valid.size:
                            yield tiles.packed([piece], kinds, {"tr": [tr], "tc": [tc]})

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for k, b in zip(keys, tiles.unpacked(batch, count), strict=True):
                if k != key:
                    if key is not None:
                        yield tiles.packed([_drawn(t, box(*key), parts, method, m.dtype, size)], kinds)
                    key, parts = k, []
                parts.append(b)
        if key is not None:
            yield tiles.packed([_drawn(t, box(*key), parts, method, m.dtype, size)], kinds)

    schema = tiles.block_type(kinds, "tr int, tc int, ")
    nothing = [F.lit(0).alias(n) for n in tiles.PLACES] + [F.expr(f"cast(array() as array<{k}>)").alias(f"b{i}") for i, k in enumerate(kinds, 1)]
    every = ds.spark.range(-(-height // side) * across).select(F.expr(f"cast(id div {across} as int)").alias("tr"), F.expr(f"cast(id % {across} as int)").alias("tc"), *nothing)
    moved = ds.tiles().mapInArrow(send, schema).unionByName(every).repartition("tr", "tc").sortWithinPartitions("tr", "tc")
    return tiles.pixels_of(moved.mapInArrow(receive, tiles.block_type(kinds)), count)


def _bounds(x: np.ndarray, side: int) -> tuple[int, int]:
    """The tiles, from and to, that a sheet of places covers: its extent, and as much more as neighbouring places lie apart."""
    good = x[np.isfinite(x)]
    with np.errstate(invalid="ignore"):
        apart = [np.abs(np.diff(x, axis=a)) for a in (0, 1)]
    apart = np.concatenate([d[np.isfinite(d)] for d in apart])
    more = min(float(apart.max(initial=0.0)), 1e9) + 1
    return math.floor(max(good.min() - more, -1e9) / side), math.floor(min(good.max() + more, 1e9) / side)


def _drawn(t: Transformer, box: tuple[int, int, int, int], parts: list[Block], method: str, dtype: str, size: tuple[int, int]) -> Block:
    """A target tile from the pieces it reads."""
    r0, r1, c0, c1 = box
    u, v = (t.exact_places if method == "nearest" else t.places)(*box)
    with np.errstate(invalid="ignore"):
        inside = (u >= 0) & (u < size[1]) & (v >= 0) & (v < size[0])
    u, v = np.where(inside, u, -9.0), np.where(inside, v, -9.0)
    count, parts = parts[0].valid.shape[0], [p for p in parts if p.valid.size]
    if method == "nearest":
        out = np.zeros((count, *u.shape), parts[0].values.dtype if parts else np.float64)
        good = np.zeros(out.shape, bool)
        taps: list[tuple[int, Any]] = [(0, None)]
        row, col = np.floor(v).astype(int), np.floor(u).astype(int)
    else:
        n = SUPPORT[method]
        out, weight = np.zeros((count, *u.shape)), np.zeros((count, *u.shape))
        taps = [(k, (weights(method, np.floor(v - 0.5) + k + 0.5 - v), weights(method, np.floor(u - 0.5) + k + 0.5 - u))) for k in range(1 - n, n + 1)]
        row, col = np.floor(v - 0.5).astype(int), np.floor(u - 0.5).astype(int)
    for p in parts:
        end = p.row0 + p.shape[0], p.col0 + p.shape[1]
        for i, down in taps:
            in_row = inside & (row + i >= p.row0) & (row + i < end[0])
            if not in_row.any():
                continue
            for j, over in taps:
                at = np.nonzero(in_row & (col + j >= p.col0) & (col + j < end[1]))
                if not len(at[0]):
                    continue
                y, x = row[at] + i - p.row0, col[at] + j - p.col0
                if method == "nearest":
                    out[:, at[0], at[1]], good[:, at[0], at[1]] = p.values[:, y, x], p.valid[:, y, x]
                    continue
                w = np.where(p.valid[:, y, x], down[0][at] * over[1][at], 0.0)
                out[:, at[0], at[1]] += np.where(w != 0, w * p.values[:, y, x], 0.0)
                weight[:, at[0], at[1]] += w
    if method != "nearest":
        good = np.abs(weight) > 1e-9
        out = rounded(out / np.where(good, weight, 1.0), dtype)
    return Block(r0, c0, out, good)
