"""Best-fit packing by patterns: few-document length patterns fitted to the length histogram by non-negative least squares.

The plan is made from the histogram alone, which has at most ``capacity`` bins whatever the corpus holds, so the driver's
work and memory don't grow with the data. Documents are then dealt to the plan's places by their number within a length.

Defined cases: a null text counts as empty and gives one piece that holds only the end id; repeated rows and null ids are
packed row by row; an empty table gives no pieces; extra columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import SLICE_BYTES, Scratch, dense_rank_in, slices, text_buffer, trim

#: Second lengths tried for each first length of a three-document pattern.
TRIPLES = 16
NNLS_STEPS = 400


def token_pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids, cut only beyond ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.word_encoder(tokenizer), int(end_id).to_bytes(4, "little")
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in slices(offsets, SLICE_BYTES // 2):
                rows, piece, start, length, crc = [], [], [], [], []
                ids, bounds = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                raw, bounds = memoryview(ids.astype("<u4").tobytes()), bounds.tolist()
                for i in range(b - a):
                    lo, hi = bounds[i], bounds[i + 1]
                    for k, at in enumerate(range(lo, hi + 1, capacity)):
                        stop = min(at + capacity, hi + 1)
                        sum_ = zlib.crc32(raw[4 * at : 4 * min(stop, hi)])
                        rows.append(a + i), piece.append(k), start.append(at - lo), length.append(stop - at), crc.append(zlib.crc32(end, sum_) if stop > hi else sum_)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def nnls(columns: np.ndarray, target: np.ndarray, steps: int = NNLS_STEPS) -> np.ndarray:
    """x >= 0 that nearly minimises |A x - target|; row j of ``columns`` holds pattern j's lengths, 0 where it has fewer.

    Accelerated projected gradient on the sparse pattern matrix.
    """
    n, (m, depth) = len(target), columns.shape
    if not m:
        return np.zeros(0)
    used = (columns > 0).astype(float)
    flat = columns.ravel()
    a = lambda x: np.bincount(flat, (used * x[:, None]).ravel(), n)
    at = lambda r: (used * r[columns]).sum(1)
    v = np.ones(m)
    for _ in range(20):  # the largest eigenvalue gives the step
        v = at(a(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(at(a(v))) + 1e-9)
    x = y = np.zeros(m)
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * at(a(y) - target))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def patterns(hist: np.ndarray, capacity: int) -> np.ndarray:
    """Lengths of exact one-, two- and three-document patterns over the lengths that occur."""
    there = np.flatnonzero(hist)
    found = [(capacity, 0, 0)] if capacity < len(hist) and hist[capacity] else []
    found += [(int(a), int(capacity - a), 0) for a in there if capacity / 2 <= a < capacity and hist[capacity - a]]
    for a in there[(there >= capacity / 3) & (there < capacity)]:
        low, high = (capacity - a + 1) // 2, min(a, capacity - a - 1)
        bs = there[(there >= low) & (there <= high)]
        bs = bs[hist[capacity - a - bs] > 0]
        for b in bs[np.unique(np.linspace(0, len(bs) - 1, min(len(bs), TRIPLES)).astype(int))] if len(bs) else ():
            found.append((int(a), int(b), int(capacity - a - b)))
    return np.array(found, np.int64).reshape(-1, 3)


def plan(hist: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths in one sequence, number of such sequences): every document of the histogram has a place.

    Patterns take the rounded-down NNLS counts; the rest goes, longest first, to the fullest sequence with room, by counts.
    """
    left = hist.astype(np.int64).copy()
    out: list[tuple[list[int], int]] = []
    columns = patterns(hist, capacity)
    for lengths, x in zip(columns.tolist(), np.floor(nnls(columns, hist.astype(float)) + 1e-6).astype(np.int64).tolist(), strict=True):
        own = [v for v in lengths if v]
        n = min([x, *(int(left[v]) // own.count(v) for v in set(own))])
        if n > 0:
            out.append((own, n))
            for v in own:
                left[v] -= n
    gaps: list[int] = []  # sorted; open sequences by room
    runs: dict[int, list[tuple[list[int], int]]] = {}

    def put(room: int, run: tuple[list[int], int]) -> None:
        if room not in runs:
            bisect.insort(gaps, room)
            runs[room] = []
        runs[room].append(run)

    for length in np.flatnonzero(left)[::-1].tolist():
        count = int(left[length])
        while count:
            k = bisect.bisect_left(gaps, length)
            if k < len(gaps):
                room = gaps[k]
                own, n = runs[room].pop()
                if not runs[room]:
                    del runs[room], gaps[k]
                each = min(room // length, -(-count // n))
                full = min(n, count // each)
                if full < n:
                    put(room, (own, n - full))
                if full:
                    put(room - each * length, (own + [length] * each, full))
                    count -= each * full
            else:
                each = min(capacity // length, count)
                put(capacity - each * length, ([length] * each, count // each))
                count -= each * (count // each)
    return out + [r for rs in runs.values() for r in rs]


def places(packed: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """The plan as runs: documents of ``length`` numbered from ``first`` on fill ``per`` places of each sequence from ``seq`` on."""
    cursor: dict[int, int] = {}
    rows = []
    seq = 0
    for lengths, copies in packed:
        at = 0
        while lengths:
            v = lengths[0]
            per = lengths.count(v)
            rows.append((v, cursor.get(v, 0), per, seq, at))
            cursor[v] = cursor.get(v, 0) + per * copies
            at += v * per
            lengths = [x for x in lengths if x != v]
        seq += copies
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "per", "seq", "offset"), cols, strict=True))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces (column ``length``, 1 to ``capacity``); other columns stay.

    The histogram has at most ``capacity`` rows; the plan derived from it has a few times that many runs, so both fit the
    driver and a closure at any corpus size.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark, "pack")
    kept = scratch.keep(pieces.withColumn("__uid", F.monotonically_increasing_id()))
    hist = np.zeros(capacity + 1, np.int64)
    for r in kept.groupBy("length").count().collect():
        hist[r[0]] = r[1]
    runs = places(plan(hist, capacity))
    span = int(hist.sum()) + 1
    numbered = dense_rank_in(kept, ["length"], ["__uid"], "__rank", span)
    columns = [c for c in pieces.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = runs["length"] * span + runs["first"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__rank"))
            k = np.searchsorted(key, length * span + rank, "right") - 1
            d = rank - runs["first"][k]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(runs["seq"][k] + d // runs["per"][k], pa.int64()), pa.array(runs["offset"][k] + d % runs["per"][k] * length, pa.int64())],
                names=[*columns, "sequence_id", "offset"],
            )

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.mapInArrow(run, f"{kind}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Packs all documents (doc_id, text) into sequences of at most ``capacity`` ids; one row per piece."""
    return pack(token_pieces(docs, capacity, tokenizer or tokens.tokenizer_path("word_bpe_49k.json"), end_id), capacity)
