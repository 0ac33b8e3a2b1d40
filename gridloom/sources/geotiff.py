"""A GeoTIFF codec: header on the driver, blocks of pixels on the executors, by byte ranges of any file system (``ranges``).

Read: classic and big TIFF of either byte order, strips or tiles, chunky or planar, uncompressed, deflate, LZW, PackBits or
Zstandard, horizontal and floating-point predictors, blocks that are left out. Written: deflated tiles or strips, classic or big
as the size asks; tasks encode the blocks, and the driver copies them behind one another.
"""

from __future__ import annotations

import base64
import os
import pickle
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..errors import BackendError
from ..meta import STORAGE, Affine, RasterMeta
from .ranges import HEAD_BYTES, WINDOW_BYTES, Ranges, SessionRanges, SessionWriter, scheme

#: Beyond so many bytes of blocks a file is a big TIFF.
BIG_BYTES = 4 * 10**9
#: TIFF field types, sample formats, GeoKeys.
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
_FORMATS = {1: "uint", 2: "int", 3: "float"}
_MODEL, _RASTER, _GEOGRAPHIC, _PROJECTED = 1024, 1025, 2048, 3072
_SCALE, _TIEPOINT, _MATRIX, _KEYS, _METADATA, _NODATA = 33550, 33922, 34264, 34735, 42112, 42113


@dataclass
class Header:
    meta: RasterMeta
    order: str
    offsets: list[int]
    counts: list[int]
    block: tuple[int, int]
    tiled: bool
    planar: bool
    compression: int
    predictor: int


def read_header(source: str | Ranges) -> Header:
    """The first image's header; no pixel is read. Of a path that this process opens, or of given byte ranges."""
    if isinstance(source, str):
        with Ranges(source) as r:
            return read_header(r)
    head = source.read(0, HEAD_BYTES)

    def read(at: int, n: int) -> bytes:
        return head[at : at + n] if at + n <= len(head) else source.read(at, n)

    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise BackendError(f"{source.path} is no TIFF file")
    # widths of an entry's numbers: classic and big
    count_code, number, entry = ("H", "I", 12) if magic == 42 else ("Q", "Q", 20)
    room = struct.calcsize(order + number)
    at = struct.unpack(order + number, read(4 if magic == 42 else 8, room))[0]
    n = struct.unpack(order + count_code, read(at, struct.calcsize(order + count_code)))[0]
    entries = read(at + struct.calcsize(order + count_code), entry * n)
    tags: dict[int, Any] = {}
    for i in range(n):
        one_entry = entries[entry * i : entry * (i + 1)]
        tag, kind, count = struct.unpack(order + "HH" + number, one_entry[: 4 + room])
        code = _TYPES.get(kind)
        if code is None:
            continue
        size = struct.calcsize(order + code) * count
        raw = one_entry[4 + room :]
        if size > room:
            raw = read(struct.unpack(order + number, raw)[0], size)
        tags[tag] = raw[:size].split(b"\0")[0].decode("utf-8", "replace") if kind == 2 else struct.unpack(order + (f"{count}{code}" if len(code) == 1 else code * count), raw[:size])
    one = lambda t, d: tags.get(t, (d,))[0]
    width, height, count = one(256, 0), one(257, 0), one(277, 1)
    dtype = f"{_FORMATS.get(one(339, 1), 'uint')}{one(258, 8)}"
    if dtype not in STORAGE:
        raise BackendError(f"unsupported pixel type {dtype}")
    if _MATRIX in tags:
        m = tags[_MATRIX]
        transform = Affine(m[0], m[1], m[3], m[4], m[5], m[7])
    elif _SCALE in tags and _TIEPOINT in tags:
        s, t = tags[_SCALE], tags[_TIEPOINT]
        transform = Affine.from_origin(t[3] - t[0] * s[0], t[4] + t[1] * s[1], s[0], s[1])
    else:
        transform = Affine()
    keys = tags.get(_KEYS, ())
    geo = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    epsg = geo.get(_PROJECTED) or geo.get(_GEOGRAPHIC)
    nodata = tags.get(_NODATA)
    if nodata is not None:
        nodata = float(nodata)
        nodata = int(nodata) if not dtype.startswith("float") and nodata == nodata else nodata
    names: list[str | None] = [None] * count
    for sample, text in re.findall(r'<Item name="DESCRIPTION" sample="(\d+)"[^>]*>([^<]*)</Item>', tags.get(_METADATA, "")):
        if int(sample) < count:
            names[int(sample)] = text.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")
    tiled = 322 in tags
    block = (one(323, 0), one(322, 0)) if tiled else (min(one(278, height), height), width)
    meta = RasterMeta(height, width, dtype, count, transform, f"EPSG:{epsg}" if epsg and epsg != 32767 else None, nodata, tuple(names))
    return Header(meta, order, list(tags[324 if tiled else 273]), list(tags[325 if tiled else 279]), block, tiled, one(284, 1) == 2, one(259, 1), one(317, 1))


def _lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of growing width, highest bit first."""
    out, table, width, previous = bytearray(), [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
    bits = have = 0
    for byte in data:
        bits, have = (bits << 8) | byte, have + 8
        while have >= width:
            have -= width
            code = (bits >> have) & ((1 << width) - 1)
            bits &= (1 << have) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, previous = table[:258], 9, b""
                continue
            entry = table[code] if code < len(table) else previous + previous[:1]
            out += entry
            if previous:
                table.append(previous + entry[:1])
            previous = entry
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def _packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i] - 256 if data[i] > 127 else data[i]
        i += 1
        if n >= 0:
            out += data[i : i + n + 1]
            i += n + 1
        elif n != -128:
            out += data[i : i + 1] * (1 - n)
            i += 1
    return bytes(out)


def decode_block(h: Header, raw: bytes) -> np.ndarray:
    """A block as (rows, cols, samples)."""
    unpack = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress, 5: _lzw, 32773: _packbits, 50000: _zstd}.get(h.compression)
    if unpack is None:
        raise BackendError(f"unsupported compression {h.compression}")
    samples = 1 if h.planar else h.meta.count
    if not raw:  # a block that is left out
        fill = h.meta.nodata if h.meta.nodata is not None else 0
        return np.full((*h.block, samples), fill, np.dtype(h.meta.dtype))
    data = unpack(raw)
    if h.predictor == 3:  # bytes of a line are differences, the highest bytes of all its numbers first
        size, line = np.dtype(h.meta.dtype).itemsize, h.block[1] * samples
        rows = len(data) // (line * size)
        flat = np.cumsum(np.frombuffer(data, np.uint8, rows * line * size).reshape(rows, size * line // samples, samples), axis=1, dtype=np.uint8)
        values = np.ascontiguousarray(flat.reshape(rows, size, line).transpose(0, 2, 1)).view(f">f{size}")
        return values.reshape(rows, h.block[1], samples).astype(h.meta.dtype)
    values = np.frombuffer(data, np.dtype(h.meta.dtype).newbyteorder(h.order))
    rows = len(values) // (h.block[1] * samples)
    values = values[: rows * h.block[1] * samples].reshape(rows, h.block[1], samples)
    if h.predictor == 2:
        values = np.cumsum(values, axis=1, dtype=np.dtype(h.meta.dtype))
    elif h.predictor != 1:
        raise BackendError(f"unsupported predictor {h.predictor}")
    return values.astype(h.meta.dtype)


def per_plane(h: Header) -> tuple[int, int]:
    """Blocks down and across."""
    return -(-h.meta.height // h.block[0]), -(-h.meta.width // h.block[1])


def block_numbers(h: Header, top: int, bottom: int, left: int, right: int) -> list[int]:
    """The blocks of the first plane that hold a window, its last row and column included."""
    if top > bottom or left > right:
        return []
    _, across = per_plane(h)
    return [r * across + c for r in range(top // h.block[0], bottom // h.block[0] + 1) for c in range(left // h.block[1], right // h.block[1] + 1)]


def pixels_of_block(h: Header, k: int, load: Callable[[int], bytes]) -> pa.RecordBatch:
    """row, col, b1 ... of block k; ``load`` gives a block's bytes by its number over all planes."""
    kinds = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}
    kind, (down, across) = kinds[STORAGE[h.meta.dtype]], per_plane(h)
    planes = [decode_block(h, load(k + p * down * across))[:, :, 0] for p in range(h.meta.count)] if h.planar else np.moveaxis(decode_block(h, load(k)), 2, 0)
    r0, c0 = k // across * h.block[0], k % across * h.block[1]
    rows, cols = min(len(planes[0]), h.meta.height - r0), min(h.block[1], h.meta.width - c0)
    r, c = np.indices((rows, cols), np.int32)
    return pa.RecordBatch.from_arrays([pa.array((r + r0).ravel(), pa.int32()), pa.array((c + c0).ravel(), pa.int32()), *(pa.array(p[:rows, :cols].ravel()).cast(kind) for p in planes)], names=["row", "col", *(f"b{i}" for i in range(1, h.meta.count + 1))])


def pixel_schema(m: RasterMeta) -> str:
    return "row int, col int, " + ", ".join(f"b{i} {STORAGE[m.dtype]}" for i in range(1, m.count + 1))


def from_session(spark: SparkSession, path: str, h: Header, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Pixels of a file that tasks can't open: of a window (first and last row, first and last column), or of all of it.

    The blocks of a window of at most ``WINDOW_BYTES`` are read as byte ranges by the driver and decoded by tasks; for more, Spark
    reads the file on an executor.
    """
    down, across = per_plane(h)
    planes = range(h.meta.count) if h.planar else range(1)
    numbers = block_numbers(h, *(window or (0, h.meta.height - 1, 0, h.meta.width - 1)))
    needed = [k + p * down * across for k in numbers for p in planes]
    if window and sum(h.counts[i] for i in needed) <= WINDOW_BYTES:
        with SessionRanges(spark, path) as f:
            rows = [(k, [bytearray(f.read(h.offsets[i], h.counts[i])) if h.counts[i] else bytearray() for i in (k + p * down * across for p in planes)]) for k in numbers]

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, blobs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield pixels_of_block(h, k, lambda i: blobs[(i - k) // (down * across)])  # noqa: B023

        return spark.createDataFrame(rows, "k int, blobs array<binary>").mapInArrow(decode, pixel_schema(h.meta))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = memoryview(content.as_buffer())
                for k in numbers:
                    yield pixels_of_block(h, k, lambda i: bytes(raw[h.offsets[i] : h.offsets[i] + h.counts[i]]))  # noqa: B023

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(whole, pixel_schema(h.meta))


class Blocks(InputPartition):
    def __init__(self, numbers: list[int]):
        self.numbers = numbers


class GeoTiffReader(DataSourceReader):
    """Pixels (row, col, b1 ...), read and decoded block by block."""

    BLOCKS = 16

    def __init__(self, path: str, header: Header | None = None):
        self.path, self.header = path, header or read_header(path)
        self.window = {"row": (0, self.header.meta.height - 1), "col": (0, self.header.meta.width - 1)}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Ranges of row and col narrow the window whose blocks are read; Spark still applies every filter to their pixels."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.window and getattr(f, "value", None) is not None:
                low, high = self.window[name]
                v = f.value
                if isinstance(f, EqualTo):
                    low, high = max(low, v), min(high, v)
                elif isinstance(f, In):
                    low, high = max(low, min(v, default=low)), min(high, max(v, default=high))
                elif isinstance(f, GreaterThanOrEqual):
                    low = max(low, v)
                elif isinstance(f, GreaterThan):
                    low = max(low, v + 1)
                elif isinstance(f, LessThanOrEqual):
                    high = min(high, v)
                elif isinstance(f, LessThan):
                    high = min(high, v - 1)
                self.window[name] = (low, high)
            yield f

    def partitions(self) -> list[InputPartition]:
        numbers = block_numbers(self.header, *self.window["row"], *self.window["col"])
        if not numbers:
            return [Blocks([])]
        return [Blocks(numbers[a : a + self.BLOCKS]) for a in range(0, len(numbers), self.BLOCKS)]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        with Ranges(self.path) as f:
            for k in partition.numbers:
                yield pixels_of_block(self.header, k, lambda i: f.read(self.header.offsets[i], self.header.counts[i]) if self.header.counts[i] else b"")


class GeoTiffSource(DataSource):
    """``spark.read.format("geotiff").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def _header(self) -> Header:
        known = self.options.get("header")
        return pickle.loads(base64.b64decode(known)) if known else read_header(self.options["path"])

    def schema(self) -> str:
        return pixel_schema(self._header().meta)

    def reader(self, schema: Any) -> DataSourceReader:
        return GeoTiffReader(self.options["path"], self._header())


def header_option(h: Header) -> str:
    """A header that was read once, as the reader's option ``header``."""
    return base64.b64encode(pickle.dumps(h)).decode()


def _fields(meta: RasterMeta, block: tuple[int, int], tiled: bool) -> list[tuple[int, int, Any]]:
    """Tags of a deflated planar file, without the places of its blocks."""
    dtype = np.dtype(meta.dtype)
    fields: list[tuple[int, int, Any]] = [(256, 4, [meta.width]), (257, 4, [meta.height]), (258, 3, [dtype.itemsize * 8] * meta.count), (259, 3, [8]), (262, 3, [1]), (277, 3, [meta.count]), (284, 3, [2]), (339, 3, [{"u": 1, "i": 2, "f": 3}[dtype.kind]] * meta.count)]
    fields += [(322, 4, [block[1]]), (323, 4, [block[0]])] if tiled else [(278, 4, [block[0]])]
    if meta.count > 1:
        fields.append((338, 3, [0] * (meta.count - 1)))
    t = meta.transform
    if t.rotated or t.e > 0:
        fields.append((_MATRIX, 12, [t.a, t.b, 0, t.c, t.d, t.e, 0, t.f, 0, 0, 0, 0, 0, 0, 0, 1]))
    else:
        fields += [(_SCALE, 12, [t.a, -t.e, 0]), (_TIEPOINT, 12, [0, 0, 0, t.c, t.f, 0])]
    if meta.crs and meta.crs.startswith("EPSG:"):
        number = int(meta.crs[5:])
        geographic = number in (4326, 4258, 4269)
        fields.append((_KEYS, 3, [1, 1, 0, 3, _MODEL, 0, 1, 2 if geographic else 1, _RASTER, 0, 1, 1, _GEOGRAPHIC if geographic else _PROJECTED, 0, 1, number]))
    if any(meta.band_names):
        items = "".join(f'<Item name="DESCRIPTION" sample="{i}" role="description">{n.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")}</Item>' for i, n in enumerate(meta.band_names) if n)
        fields.append((_METADATA, 2, f"<GDALMetadata>{items}</GDALMetadata>"))
    if meta.nodata is not None:
        fields.append((_NODATA, 2, "nan" if meta.nodata != meta.nodata else repr(meta.nodata)))
    return fields


def _directory(fields: list[tuple[int, int, Any]], at: int, big: bool) -> bytes:
    """An image file directory that lies at ``at``, the values that don't fit an entry behind it."""
    count_code, number, room = ("Q", "Q", 8) if big else ("H", "I", 4)
    fields = sorted(fields, key=lambda x: x[0])
    place = at + struct.calcsize("<" + count_code) + (12 + 8 * big) * len(fields) + room
    entries, bodies = struct.pack("<" + count_code, len(fields)), []
    for tag, kind, v in fields:
        raw = v.encode() + b"\0" if kind == 2 else struct.pack(f"<{len(v)}{_TYPES[kind]}", *v)
        entries += struct.pack("<HH" + number, tag, kind, len(raw) if kind == 2 else len(v))
        if len(raw) <= room:
            entries += raw.ljust(room, b"\0")
        else:
            entries += struct.pack("<" + number, place)
            bodies.append(raw + b"\0" * (len(raw) % 2))
            place += len(bodies[-1])
    return entries + b"\0" * room + b"".join(bodies)


def write(spark: SparkSession, path: str, blocks: DataFrame, meta: RasterMeta, side: int, big: bool | None = None) -> None:
    """A file of a raster's tiles (``Raster.tiles``), wherever the session can write.

    Tasks encode each tile, and Spark keeps the encoded blocks in a table beside the file. The driver sums their sizes, then copies
    one partition of blocks after another, remembers where each began, and ends the file with its directory. Blocks stand in the
    order in which they come; narrow rasters are written as strips.
    """
    dtype, strips = np.dtype(meta.dtype), meta.width <= side
    block = (min(64, meta.height), meta.width) if strips else (side, side)
    down, across = -(-meta.height // block[0]), -(-meta.width // block[1])
    fill = meta.nodata if meta.nodata is not None else (np.nan if dtype.kind == "f" else 0)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..operators.tiles import unpacked

        for batch in batches:
            for b in unpacked(batch, meta.count):
                numbers, data = [], []
                for i in range(meta.count):
                    pixels = np.where(b.valid[i], b.values[i], fill).astype(dtype.newbyteorder("<"))
                    for r in range(0, b.shape[0], block[0]):
                        part = pixels[r : r + block[0]]
                        if not strips:
                            part = np.pad(part, [(0, block[0] - part.shape[0]), (0, block[1] - part.shape[1])])
                        numbers.append((i * down + (b.row0 + r) // block[0]) * across + b.col0 // block[1])
                        data.append(zlib.compress(part.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(data, pa.binary())], names=["number", "data"])

    if side % block[0] and strips and meta.height > side:
        raise BackendError("a tile holds whole strips")
    place = f"{path}.blocks-{uuid.uuid4().hex}"
    place = place if scheme(place) else "file://" + os.path.abspath(place)
    blocks.mapInArrow(encode, "number long, data binary").write.parquet(place)
    stored = spark.read.schema("number long, data binary").parquet(place)
    n, total = stored.selectExpr("count(1)", "coalesce(sum(length(data)), 0)").first()
    if n != down * across * meta.count:
        raise BackendError(f"{n} blocks of {down * across * meta.count}")
    big = total > BIG_BYTES if big is None else big
    at, starts, sizes = 16 if big else 8, np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    out = SessionWriter(spark, path)
    end = at + total + total % 2
    out.write(b"II" + (struct.pack("<HHHQ", 43, 8, 0, end) if big else struct.pack("<HI", 42, end)))
    for row in stored.toLocalIterator():
        out.write(bytes(row.data))
        starts[row.number], sizes[row.number] = at, len(row.data)
        at += len(row.data)
    out.write(b"\0" * (end - at))
    kind = 16 if big else 4
    out.write(_directory([*_fields(meta, block, not strips), (273 if strips else 324, kind, starts.tolist()), (279 if strips else 325, kind, sizes.tolist())], end, big))
    out.close()
    where = spark._jvm.org.apache.hadoop.fs.Path(place)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
