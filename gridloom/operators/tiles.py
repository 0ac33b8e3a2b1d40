"""Rasters as blocks of pixels, and halos.

A block is one row: where its first pixel lies, its height and width, and one array per band, NULL at nodata. Tiles are blocks
of a regular net. An operation that looks at a pixel's surroundings runs on whole blocks, as array arithmetic; no block ever
moves for it. Inside a tile, away from its edges, results need nothing else. Around the net's lines they need what lies on both
sides: every tile sends strips of twice the radius along its edges to the seam they belong to, and the seam is computed there.
So of a tile of side T only about 8 * radius / T of the pixels are shuffled, whatever the raster's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side of the square tiles of stored rasters.
TILE = 256
#: The coarsest overview is at most this long and wide.
LEAST_SIDE = 32
#: Columns that say where a block lies.
PLACES = ("row0", "col0", "h", "w")


@dataclass
class Block:
    """Pixels from (row0, col0) on: values, as one array or a list of arrays of their own types, and which are valid."""

    row0: int
    col0: int
    values: np.ndarray | list[np.ndarray]
    valid: np.ndarray

    @property
    def shape(self) -> tuple[int, int]:
        return self.valid.shape[1], self.valid.shape[2]

    def part(self, r0: int, r1: int, c0: int, c1: int) -> Block:
        """The pixels of grid rows r0 to r1 and columns c0 to c1, as far as the block holds them."""
        r0, c0 = max(r0, self.row0), max(c0, self.col0)
        rows = slice(r0 - self.row0, max(r0, min(r1, self.row0 + self.shape[0])) - self.row0)
        cols = slice(c0 - self.col0, max(c0, min(c1, self.col0 + self.shape[1])) - self.col0)
        return Block(r0, c0, self.values[:, rows, cols], self.valid[:, rows, cols])


#: From a block with its halo and its core (row from, row to, column from, column to) to a block of results, or none.
Compute = Callable[[Block, tuple[int, int, int, int]], "Block | None"]


def block_type(kinds: list[str], extra: str = "") -> str:
    return extra + "row0 int, col0 int, h int, w int, " + ", ".join(f"b{i} array<{k}>" for i, k in enumerate(kinds, 1))


_ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_()}


def packed(blocks: list[Block], kinds: list[str], extra: dict[str, list[int]] | None = None) -> pa.RecordBatch:
    """Blocks as rows."""
    columns = [pa.array(v, pa.int32()) for v in (extra or {}).values()]
    columns += [pa.array([v(b) for b in blocks], pa.int32()) for v in (lambda b: b.row0, lambda b: b.col0, lambda b: b.shape[0], lambda b: b.shape[1])]
    ends = pa.array(np.concatenate([[0], np.cumsum([b.shape[0] * b.shape[1] for b in blocks])]), pa.int32())
    for i, kind in enumerate(kinds):
        arrow = _ARROW[kind]
        flat = np.concatenate([b.values[i].ravel() for b in blocks] or [np.zeros(0)])
        gone = ~np.concatenate([b.valid[i].ravel() for b in blocks] or [np.zeros(0, bool)])
        if gone.any() and flat.dtype.kind == "f":
            flat = np.where(gone, 0, flat)
        columns.append(pa.ListArray.from_arrays(ends, pa.array(flat.astype(arrow.to_pandas_dtype()), arrow, mask=gone)))
    return pa.RecordBatch.from_arrays(columns, names=[*(extra or {}), *PLACES, *[f"b{i}" for i in range(1, len(kinds) + 1)]])


def unpacked(batch: pa.RecordBatch, count: int) -> Iterator[Block]:
    """Rows as blocks; integers of up to 32 bits and floats as doubles, wider ones as they are."""
    place = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in PLACES]
    bands = []
    for i in range(1, count + 1):
        lists = batch.column(batch.schema.get_field_index(f"b{i}"))
        flat, offsets = lists.values, lists.offsets.to_numpy()
        good = flat.is_valid().to_numpy(zero_copy_only=False)
        values = flat.fill_null(False if pa.types.is_boolean(flat.type) else 0).to_numpy(zero_copy_only=False)
        bands.append((values if pa.types.is_int64(flat.type) else values.astype(np.float64), good, offsets))
    for k, (r, c, h, w) in enumerate(zip(*place, strict=True)):
        cut = [slice(o[k], o[k + 1]) for _, _, o in bands]
        values = np.stack([v[s].reshape(h, w) for (v, _, _), s in zip(bands, cut, strict=True)])
        yield Block(r, c, values, np.stack([g[s].reshape(h, w) for (_, g, _), s in zip(bands, cut, strict=True)]))


def pixels_of(blocks: DataFrame, count: int, *others: str) -> DataFrame:
    """row, col, b1 ...: one row per pixel, block by block, without a shuffle or Python; ``others``: columns that each pixel keeps."""
    names = [f"b{i}" for i in range(1, count + 1)]
    each = blocks.select("row0", "col0", "w", *others, F.posexplode(F.arrays_zip(*names)).alias("k", "z"))
    return each.select(F.expr("row0 + k div w").cast("int").alias("row"), (F.col("col0") + F.col("k") % F.col("w")).alias("col"), *others, *[F.col(f"z.{n}").alias(n) for n in names])


def tiles_of(pixels: DataFrame, height: int, width: int, kinds: list[str], side: int = TILE, in_place: bool = False) -> DataFrame:
    """Pixels (row, col, b1 ...) as tiles of a regular net; a pixel without a row is NULL.

    ``in_place``: the rows of a tile already lie one after another in one partition, as those of ``pixels_of`` do, so nothing
    is shuffled. Else every pixel is, once.
    """
    names = [f"b{i}" for i in range(1, len(kinds) + 1)]
    pixels = pixels.select("row", "col", *[F.col(n).cast(k).alias(n) for n, k in zip(names, kinds, strict=True)])
    if not in_place:
        at = pixels.withColumns({"__r": F.expr(f"row div {side}"), "__c": F.expr(f"col div {side}")})
        pixels = at.repartition("__r", "__c").sortWithinPartitions("__r", "__c").select("row", "col", *names)
    across = -(-width // side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_tile, held = -1, None
        for batch in batches:
            if not batch.num_rows:
                continue
            row, col = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            tile = row // side * across + col // side
            edges = np.flatnonzero(np.diff(tile)) + 1
            data = [batch.column(2 + i) for i in range(len(kinds))]
            good = [d.is_valid().to_numpy(zero_copy_only=False) for d in data]
            flat = [d.fill_null(False if pa.types.is_boolean(d.type) else 0).to_numpy(zero_copy_only=False) for d in data]
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(tile)], strict=True):
                if tile[a] != open_tile:
                    if held is not None:
                        yield packed([held], kinds)
                    open_tile = int(tile[a])
                    r, c = open_tile // across * side, open_tile % across * side
                    size = (min(side, height - r), min(side, width - c))
                    held = Block(r, c, [np.zeros(size, f.dtype) for f in flat], np.zeros((len(kinds), *size), bool))
                at = row[a:b] - held.row0, col[a:b] - held.col0
                for i in range(len(kinds)):
                    held.values[i][at], held.valid[i][at] = flat[i][a:b], good[i][a:b]
        if held is not None:
            yield packed([held], kinds)

    return pixels.mapInArrow(run, block_type(kinds))


def _span(band: int, side: int, radius: int, size: int) -> tuple[int, int]:
    """From and to of a band of an axis: even ones lie inside the tiles, odd ones around the lines between them."""
    tile, seam = divmod(band + 1, 2)
    if not seam:  # around the line before the tile
        return (0, 0) if tile * side >= size else (max(0, tile * side - radius), min(size, tile * side + radius))
    return tile * side + (radius if tile else 0), (tile + 1) * side - radius if (tile + 1) * side < size else size


def surrounding(tiles: DataFrame, height: int, width: int, count: int, radius: int, compute: Compute, kinds: list[str], side: int = TILE) -> DataFrame:
    """Blocks of results of ``compute``, which sees ``radius`` pixels around each core; cores cover the grid once.

    At the grid's own edges a block ends, elsewhere it holds the halo. Tiles are read twice: once for what lies inside them, in
    place, and once for the strips along their edges, which are all that is shuffled.
    """
    if not 0 < 2 * radius <= side:
        raise ValueError("a radius is at most half a tile")
    source = [t.dataType.elementType.simpleString() for t in (tiles.schema[f"b{i}"] for i in range(1, count + 1))]

    def solved(block: Block, rb: int, cb: int) -> Iterator[pa.RecordBatch]:
        (r0, r1), (c0, c1) = _span(rb, side, radius, height), _span(cb, side, radius, width)
        if r0 < r1 and c0 < c1:
            out = compute(block, (r0, r1, c0, c1))
            if out is not None and out.valid.size:
                yield packed([out], kinds)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in unpacked(batch, count):
                yield from solved(b, 2 * (b.row0 // side), 2 * (b.col0 // side))

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in unpacked(batch, count):
                rb, cb = 2 * (b.row0 // side), 2 * (b.col0 // side)
                for i in (rb - 1, rb, rb + 1):
                    for j in (cb - 1, cb, cb + 1):
                        (r0, r1), (c0, c1) = _span(i, side, radius, height), _span(j, side, radius, width)
                        if (i, j) == (rb, cb) or r0 >= r1 or c0 >= c1 or i < 0 or j < 0:
                            continue
                        piece = b.part(r0 - radius, r1 + radius, c0 - radius, c1 + radius)
                        if piece.valid.size:
                            yield packed([piece], source, {"rb": [i], "cb": [j]})

    def seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for k, b in zip(keys, unpacked(batch, count), strict=True):
                if k != key:
                    if parts:
                        yield from solved(_joined(parts), *key)
                    key, parts = k, []
                parts.append(b)
        if parts:
            yield from solved(_joined(parts), *key)

    inner = tiles.mapInArrow(inside, block_type(kinds))
    moved = tiles.mapInArrow(strips, block_type(source, "rb int, cb int, ")).repartition("rb", "cb").sortWithinPartitions("rb", "cb")
    return inner.unionByName(moved.mapInArrow(seams, block_type(kinds)))


def _joined(parts: list[Block]) -> Block:
    """Adjoining pieces of a rectangle as one block."""
    r0, c0 = min(p.row0 for p in parts), min(p.col0 for p in parts)
    size = (max(p.row0 + p.shape[0] for p in parts) - r0, max(p.col0 + p.shape[1] for p in parts) - c0)
    out = Block(r0, c0, np.zeros((len(parts[0].values), *size), parts[0].values.dtype), np.zeros((len(parts[0].values), *size), bool))
    for p in parts:
        at = slice(p.row0 - r0, p.row0 - r0 + p.shape[0]), slice(p.col0 - c0, p.col0 - c0 + p.shape[1])
        out.values[:, at[0], at[1]], out.valid[:, at[0], at[1]] = p.values, p.valid
    return out


# -- overviews --


def level_shape(height: int, width: int, level: int) -> tuple[int, int]:
    return -(-height // 2**level), -(-width // 2**level)


def level_count(height: int, width: int) -> int:
    """Levels until a side of the whole grid is at most ``LEAST_SIDE``."""
    k = 0
    while max(level_shape(height, width, k)) > LEAST_SIDE:
        k += 1
    return k


def _middle(start: int, n: int, level: int, size: int) -> tuple[int, np.ndarray]:
    """The first overview pixel that pixels from start to start + n stand for, and the places of these and the next ones' pixels."""
    step = 2**level
    i = np.arange(start // step, -(-(start + n) // step))
    at = np.minimum(i * step + step // 2, size - 1)
    mine = (at >= start) & (at < start + n)
    return (int(i[mine][0]) if mine.any() else 0), at[mine] - start


def overviews_of(tiles: DataFrame, height: int, width: int, kinds: list[str], levels: int) -> DataFrame:
    """Tiles of all levels, with ``level``: of every 2^level pixels each way the middle one, in one pass over the tiles.

    What the pass shuffles is a third of the pixels at most: the levels themselves.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in unpacked(batch, len(kinds)):
                for k in range(1, levels + 1):
                    (r, rows), (c, cols) = _middle(b.row0, b.shape[0], k, height), _middle(b.col0, b.shape[1], k, width)
                    if len(rows) and len(cols):
                        at = np.ix_(range(len(kinds)), rows, cols)
                        yield packed([Block(r, c, b.values[at], b.valid[at])], kinds, {"level": [k], "tile_row": [r // TILE], "tile_col": [c // TILE]})

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            keys = zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True)
            for k, b in zip(keys, unpacked(batch, len(kinds)), strict=True):
                if k != key:
                    if parts:
                        yield packed([_joined(parts)], kinds, {"level": [key[0]], "tile_row": [key[1]], "tile_col": [key[2]]})
                    key, parts = k, []
                parts.append(b)
        if parts:
            yield packed([_joined(parts)], kinds, {"level": [key[0]], "tile_row": [key[1]], "tile_col": [key[2]]})

    schema, at = block_type(kinds, "level int, tile_row int, tile_col int, "), ["level", "tile_row", "tile_col"]
    return tiles.mapInArrow(pieces, schema).repartition(*at).sortWithinPartitions(*at).mapInArrow(put_together, schema)


# -- surroundings of a pixel --


def differences(row_step: float, col_step: float) -> Compute:
    """Bands v, dy, dx of one band: central differences, one-sided where the grid ends, not valid beside nodata."""

    def along(v: np.ndarray, ok: np.ndarray, axis: int, step: float) -> tuple[np.ndarray, np.ndarray]:
        v, ok = np.moveaxis(v, axis, 0), np.moveaxis(ok, axis, 0)
        out, good = np.zeros(v.shape), np.zeros(v.shape, bool)
        if len(v) > 1:
            out[1:-1], good[1:-1] = (v[2:] - v[:-2]) / 2, ok[2:] & ok[:-2]
            out[0], good[0] = v[1] - v[0], ok[1] & ok[0]
            out[-1], good[-1] = v[-1] - v[-2], ok[-1] & ok[-2]
        return np.moveaxis(out, 0, axis) / abs(step), np.moveaxis(good, 0, axis)

    def compute(block: Block, core: tuple[int, int, int, int]) -> Block:
        v, ok = block.values[0], block.valid[0]
        (dy, y_ok), (dx, x_ok) = along(v, ok, 0, row_step), along(v, ok, 1, col_step)
        return Block(block.row0, block.col0, np.stack([v, dy, dx]), np.stack([ok, y_ok, x_ok])).part(*core)

    return compute


def box_means(radius: int) -> Compute:
    """Each band's mean of the valid pixels in a square of 2 * radius + 1."""

    def sums(x: np.ndarray) -> np.ndarray:
        for axis in (1, 2):
            wide = np.pad(x, [(radius, radius) if a == axis else (0, 0) for a in range(3)])
            n = x.shape[axis]
            x = sum(np.take(wide, range(k, k + n), axis) for k in range(2 * radius + 1))
        return x

    def compute(block: Block, core: tuple[int, int, int, int]) -> Block:
        total, n = sums(np.where(block.valid, block.values.astype(np.float64), 0.0)), sums(block.valid.astype(np.float64))
        with np.errstate(invalid="ignore"):
            return Block(block.row0, block.col0, total / np.maximum(n, 1), n > 0).part(*core)

    return compute
