"""Exact substring dedup by a logarithmic family of suffix arrays.

A byte goes if a string of ``min_bytes`` that covers it also starts anywhere else in the corpus. Comparing every suffix of a
corpus with every other isn't needed: each string of that length holds an anchor, the least hash among its short substrings,
and equal strings hold equal anchors at equal places. So

1. every document is scanned once for its anchors, with the anchor's hash and a 128-bit cryptographic digest of the whole
   context around it, the bytes that strings with this anchor can cover;
2. anchors that occur once are left out; equal contexts are one entry of the index, and their copies are covered whole;
3. the contexts that differ are cut from the documents and dealt by anchor to shards. Each new batch of a shard gets two suffix
   arrays in byte order: of the suffixes that start at its anchors, and of the texts in front of them read backwards. It is
   merge-scanned against every level of the shard's family: the arrays of batch and level are merged in one linear pass, and
   the common lengths of neighbours, taken from the bytes, tell which strings of ``min_bytes`` occur in both. Then the batch
   becomes a level, and levels of equal size merge, so a level's size doubles with its height;
4. covered ranges come back to their documents.

Contexts of an anchor that has very many are halved into narrower ranges, dealt by the bytes that these must share, and equal
ranges become one entry, until no shard's share of one anchor exceeds ``HOT``. Joins treat keys with a large share of the rows
apart, so neither a frequent anchor nor a frequent context is a group of one task.

Defined cases: a null text is empty; texts shorter than ``min_bytes`` lose nothing, however long others are; overlapping
repeats in one text count; rows that repeat lose all covered bytes in each copy; null ids are kept and count as rows of their
own; an empty table gives no rows; extra columns, whatever their names, are ignored or passed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Scratch, frequent_join, own_name, slices, task_width, text_buffer, trim
from .hashing import Rolling, mixed

#: Entries of one anchor, or of one range of its strings, that a shard takes.
HOT = 10_000
#: Contexts of one batch of the index family, and of one shard on average.
BATCH, SHARD = 1000, 4000
#: Entries of one anchor that a scan compares one with another; those of others meet by the intervals that they lie in.
NEAR = 8
#: Bytes of text that one step of the anchor scan handles.
STEP = SLICE_BYTES // 4


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, in two running minima over blocks."""
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def find_anchors(data: np.ndarray, ends: np.ndarray, length: int, core: int, first: int = 0, last: int | None = None) -> tuple[np.ndarray, Rolling]:
    """Anchor places of the strings of ``length`` bytes that start in [first, last) and lie in one document (``ends``: its end, per byte)."""
    rolling = Rolling(data)
    last = len(data) - length + 1 if last is None else min(last, len(data) - length + 1)
    if last <= first:
        return np.zeros(0, np.int64), rolling
    low = np.uint64((1 << 24) - 1)
    key = (rolling.windows(core) & ~low) | np.arange(len(data) - core + 1, dtype=np.uint64)
    best = (sliding_min(key, length - core + 1)[first:last] & low).astype(np.int64)
    start = np.arange(first, last)
    best = best[ends[first:last] - start >= length]
    return (best[np.flatnonzero(np.diff(best, prepend=-1))] if len(best) else best), rolling


def _anchor_rows(data: np.ndarray, offsets: np.ndarray, length: int, core: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, place, context start, context end, anchor hash, context digests), places within documents."""
    side = length - core
    digest = hashlib.blake2b
    for a, b in slices(offsets, STEP):
        size = int(offsets[b] - offsets[a])
        if size < length:
            continue
        if b - a > 1 or size <= 2 * STEP:
            parts = [(0, size, 0, size)]
        else:  # one long text: overlapping pieces
            parts = [(max(0, at - length), min(size, at + STEP + 2 * length), at, min(size, at + STEP)) for at in range(0, size, STEP)]
        seen = -1
        for lo, hi, first, last in parts:
            part = data[offsets[a] + lo : offsets[a] + hi]
            bounds = np.clip(offsets[a : b + 1] - offsets[a] - lo, 0, len(part))
            lengths = np.diff(bounds)
            ends = np.repeat(bounds[1:], lengths)
            begins = np.repeat(bounds[:-1], lengths)
            place, rolling = find_anchors(part, ends, length, core, first - lo, last - lo)
            place = place[place + lo > seen]
            if not len(place):
                continue
            seen = int(place[-1]) + lo if len(parts) > 1 else -1
            row = np.searchsorted(bounds, place, "right") - 1
            start, end = np.maximum(begins[place], place - side), np.minimum(ends[place], place + length)
            h = rolling.at(place, place + core)
            raw = memoryview(part)
            c = np.frombuffer(b"".join([digest(raw[x:y], digest_size=16).digest() for x, y in zip(start.tolist(), end.tolist(), strict=True)]), np.uint64).reshape(-1, 2)
            c = mixed(((place - start) * 100_003 + (end - start)).astype(np.uint64))[:, None] ^ c
            base = bounds[row] + (0 if len(parts) == 1 else -lo)
            yield row + a, place - base, start - base, end - base, h.view(np.int64), c[:, 0].view(np.int64), c[:, 1].view(np.int64)


def anchors(docs: DataFrame, length: int, core: int) -> DataFrame:
    """k1, k2, place, start, end, h, c1, c2 of every anchor of docs (k1, k2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for row, place, start, end, *hashes in _anchor_rows(data, offsets, length, core):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x.astype(np.int32)) for x in (place, start, end)), *(pa.array(np.ascontiguousarray(x)) for x in hashes)], names=["k1", "k2", "place", "start", "end", "h", "c1", "c2"])
        trim()

    return docs.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, place int, start int, end int, h long, c1 long, c2 long")


def common_lengths(rows: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bytes strings ``x`` and ``y`` share from their starts, from padded rows and the strings' sizes."""
    differ = rows[x] != rows[y]
    first = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.minimum(first, np.minimum(sizes[x], sizes[y]))


class Family:
    """Pairs of suffix arrays, of geometric sizes, over contexts of anchors.

    An entry is what lies right of its anchor's start and, read backwards, what lies left of it. A string of ``length`` bytes
    that starts k bytes before the anchor occurs in two entries if they share k bytes to the left and ``length - k`` to the
    right. ``low`` and ``high`` hold, per entry, the least and the greatest such k found (``high`` -1: none).
    """

    def __init__(self, length: int, side: int):
        self.length, self.side = length, side
        self.levels: list[tuple[list[int], list[int]]] = []
        self.right: list[bytes] = []
        self.left: list[bytes] = []
        self.rows = (np.zeros((0, length), np.uint8), np.zeros((0, side), np.uint8))
        self.low, self.high = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def add(self, right: list[bytes], left: list[bytes]) -> None:
        """A new batch: its suffix arrays, the scan against all levels, and the merges that equal sizes call for."""
        first, n = len(self.right), len(right)
        self.right += right
        self.left += left
        if first + n > len(self.rows[0]):
            self.rows = tuple(np.concatenate([r, np.zeros((max(n, len(r)), r.shape[1]), np.uint8)]) for r in self.rows)
        for rows, strings in zip(self.rows, (right, left), strict=True):
            size = np.array([len(x) for x in strings])
            flat = np.frombuffer(b"".join(strings), np.uint8)
            at = np.repeat((np.arange(n) + first) * rows.shape[1] - (np.cumsum(size) - size), size) + np.arange(len(flat))
            rows.reshape(-1)[at] = flat
        self.sizes = tuple(np.concatenate([old, np.array([len(x) for x in strings], np.int64)]) for old, strings in zip(getattr(self, "sizes", (np.zeros(0, np.int64),) * 2), (right, left), strict=True))
        self.low = np.concatenate([self.low, np.full(n, self.length, np.int32)])
        self.high = np.concatenate([self.high, np.full(n, -1, np.int32)])
        own = range(first, first + n)
        new = (sorted(own, key=self.right.__getitem__), sorted(own, key=self.left.__getitem__))
        if not self.levels:
            self._scan(new)
        for level in self.levels:
            self._scan(self._merged(level, new))
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-1][0]) >= len(self.levels[-2][0]) / 2:
            a, b = self.levels.pop(), self.levels.pop()
            self.levels.append(self._merged(b, a))

    def _merged(self, a: tuple, b: tuple) -> tuple[list[int], list[int]]:
        """Two runs in byte order are one in a single pass: the sort finds and merges them."""
        return sorted(a[0] + b[0], key=self.right.__getitem__), sorted(a[1] + b[1], key=self.left.__getitem__)

    def _scan(self, arrays: tuple[list[int], list[int]]) -> None:
        """Marks all strings that two entries of merged arrays share."""
        by_right, by_left = (np.array(x) for x in arrays)
        n = len(by_right)
        if n < 2:
            return
        place = np.empty(len(self.right), np.int32)
        place[by_right] = np.arange(n)
        right, left = (common_lengths(r, s, o[:-1], o[1:]) for r, s, o in zip(self.rows, self.sizes, (by_right, by_left), strict=True))
        left_order, entry = place[by_left], by_right  # entries are numbered by their place in by_right from here
        while True:  # leaves out what shares too little with all others, either way, until nothing goes
            best_right = np.maximum(np.append(right, 0), np.append(0, right))
            best_left = np.empty(len(entry), np.int64)
            best_left[left_order] = np.maximum(np.append(left, 0), np.append(0, left))
            able = best_right + best_left >= self.length
            if able.all():
                break
            if able.sum() < 2:
                return
            at_right, at_left = np.flatnonzero(able), np.flatnonzero(able[left_order])
            right, left = (np.minimum.reduceat(x[: at[-1]], at[:-1]) for x, at in ((right, at_right), (left, at_left)))
            left_order, entry = (np.cumsum(able) - 1)[left_order[at_left]], entry[at_right]
        anchor = np.append(0, np.cumsum(right < self.length - self.side))
        few = np.bincount(anchor)[anchor] <= NEAR
        self._neighbours(entry, anchor, few, right)
        if few.all():
            return
        # entries of an anchor with more: at each k, those of one interval of either array share a string
        m, best_left = len(entry), np.where(few, -1, best_left)
        left_group = np.empty(m, np.int64)
        for k in range(max(0, self.length - int(best_right[~few].max())), min(self.side, int(best_left.max())) + 1):
            live = np.flatnonzero((best_right >= self.length - k) & (best_left >= k))
            if len(live) < 2:
                continue
            right_group = np.append(0, np.cumsum(right < self.length - k))
            left_group[left_order] = np.append(0, np.cumsum(left < k))
            key = right_group[live] * m + left_group[live]
            order = np.argsort(key)
            key = key[order]
            twin = np.append(key[1:] == key[:-1], False)
            twin[1:] |= twin[:-1].copy()
            self._mark(entry[live[order[twin]]], k, k)

    def _neighbours(self, entry: np.ndarray, anchor: np.ndarray, few: np.ndarray, right: np.ndarray) -> None:
        """Compares entries of anchors with at most ``NEAR`` of them with each other, a distance in the array at a time."""
        rows, sizes = self.rows[1], self.sizes[1]
        i = np.flatnonzero(few)
        shared = np.full(len(entry), self.length)
        for d in range(1, NEAR):
            i = i[i + d < len(entry)]
            i = i[anchor[i] == anchor[i + d]]
            if not len(i):
                return
            shared[i] = np.minimum(shared[i], right[i + d - 1])
            x, y = entry[i], entry[i + d]
            left = common_lengths(rows, sizes, x, y)
            hit = left + shared[i] >= self.length
            for e in (x[hit], y[hit]):
                self._mark(e, (self.length - shared[i])[hit], left[hit])

    def _mark(self, entry: np.ndarray, low: np.ndarray | int, high: np.ndarray | int) -> None:
        self.low[entry] = np.minimum(self.low[entry], low)
        self.high[entry] = np.maximum(self.high[entry], high)


_ENTRY = "shard long, d1 long, d2 long, k1 long, k2 long, place int, start int, single boolean, near int, far int, context binary"


def _entries(columns: list[pa.Array], rows: list[int], shard: list[int], digests: list[bytes], start: list[int], near: list[int], far: list[int], contexts: list[bytes]) -> pa.RecordBatch:
    """Rows of ``_ENTRY``; k1, k2, place and single (``columns``) are those of ``rows``."""
    at = pa.array(rows, pa.int64())
    k1, k2, place, single = (c.take(at) for c in columns)
    d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    arrays = [pa.array(shard, pa.int64()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), k1, k2, place.cast(pa.int32()), pa.array(start, pa.int32()), single, pa.array(near, pa.int32()), pa.array(far, pa.int32()), pa.array(contexts, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _ENTRY.split(", ")])


def _halves(context: bytes, start: int, place: int, near: int, far: int, length: int) -> Iterator[tuple[int, bytes, int, int, int, bytes]]:
    """(shard, digest, start, near, far, bytes) of the two halves of a context's strings, those that start near to far bytes before its anchor."""
    middle = (near + far + 1) // 2
    for a, b in ((near, middle - 1), (middle, far)):
        lo, hi = max(start, place - b), min(start + len(context), place - a + length)
        if b >= a and hi - lo >= length:
            shared = context[place - a - start : place - b + length - start]
            shard = hashlib.blake2b(shared, digest_size=8, key=a.to_bytes(4, "little") + b.to_bytes(4, "little")).digest()
            part = context[lo - start : hi - start]
            yield int.from_bytes(shard, "little", signed=True), hashlib.blake2b(part, digest_size=16, key=(place - lo).to_bytes(4, "little")).digest(), lo, a, b, part


def _cut_contexts(needed: DataFrame, docs: DataFrame, length: int, core: int, hot: int) -> DataFrame:
    """The bytes of needed contexts as rows of ``_ENTRY``: whole ones dealt by anchor, halves of those of frequent anchors."""
    side = length - core
    wanted = needed.groupBy("k1", "k2").agg(F.collect_list(F.struct("place", "start", "end", "h", "single", "contexts")).alias("wanted"))
    joined = docs.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = bytes(16)
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            listed = batch.column(3)
            flat = listed.flatten()
            counts = listed.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(counts)), counts)
            place, start, end, h, contexts = (flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64).tolist() for n in ("place", "start", "end", "h", "contexts"))
            which = pa.array(row)
            columns = [batch.column(0).take(which), batch.column(1).take(which), flat.field("place"), flat.field("single")]
            raw, base = memoryview(data), offsets[row].tolist()
            for at in range(0, len(row), 4096):
                out: list[tuple] = []
                for i in range(at, min(at + 4096, len(row))):
                    context = bytes(raw[base[i] + start[i] : base[i] + end[i]])
                    if contexts[i] <= hot:
                        out.append((i, h[i], none, start[i], 0, -1, context))
                    else:
                        out.extend((i, *x) for x in _halves(context, start[i], place[i], 0, side, length))
                if out:
                    yield _entries(columns, *(list(x) for x in zip(*out, strict=True)))
        trim()

    return joined.mapInArrow(run, _ENTRY)


def _cut_halves(entries: DataFrame, length: int) -> DataFrame:
    """Rows of ``_ENTRY`` cut to halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, place, start, single, near, far, context = (batch.column(j) for j in range(8))
            out: list[tuple] = []
            for i, (c, s, p, a, b) in enumerate(zip(context.to_pylist(), start.to_pylist(), place.to_pylist(), near.to_pylist(), far.to_pylist(), strict=True)):
                out.extend((i, *x) for x in _halves(c, s, p, a, b, length))
            if out:
                yield _entries([k1, k2, place, single], *(list(x) for x in zip(*out, strict=True)))

    return entries.select("k1", "k2", "place", "start", "single", "near", "far", "context").mapInArrow(run, _ENTRY)


def _narrowed(parts: DataFrame, length: int, hot: int, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """(entries for the families, covered ranges) of the halves of contexts of frequent anchors.

    Equal ranges are one entry, their copies are covered whole. Entries whose shared bytes more than ``hot`` others share are
    halved again; strings of one start that share all their bytes are equal, so this ends.
    """
    ready, ranges = [], []
    one = F.struct("k1", "k2", "place", "start", "single", "near", "far", "context")
    while True:
        kinds = scratch.keep(parts.groupBy("shard", "d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min_by(one, F.struct("k1", "k2", "place")).alias("one")))
        copies = kinds.where("n > 1").select("shard", "d1", "d2", "n")
        ranges.append(frequent_join(parts.where("single"), copies, ["shard", "d1", "d2"], "n").select("k1", "k2", "start", (F.col("start") + F.length("context")).alias("end")))
        entries = kinds.select("shard", "d1", "d2", "one.*", "n").withColumn("single", F.col("single") & (F.col("n") == 1)).drop("n")
        sizes = scratch.keep(entries.groupBy("shard").agg(F.count(F.lit(1)).alias("size")))
        if sizes.where(F.col("size") > hot).isEmpty():
            return [*ready, entries], ranges
        sized = frequent_join(entries, sizes, ["shard"], "size")
        ready.append(sized.where(F.col("size") <= hot).drop("size"))
        parts = scratch.keep(_cut_halves(sized.where(F.col("size") > hot), length))


def _family_matches(entries: DataFrame, length: int, core: int, shards: int) -> DataFrame:
    """k1, k2, start, end of the covered ranges of single contexts, found by one index family per shard."""
    per_batch = BATCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, kept = Family(length, length - core), []
        for batch in batches:
            for at in range(0, batch.num_rows, per_batch):
                part = batch.slice(at, per_batch)
                k1, k2, place, start, single = (part.column(j) for j in range(5))
                place = place.to_numpy().astype(np.int64)
                data, offsets = text_buffer(part.column(5))
                raw = data.tobytes()
                seat = (offsets[:-1] + place - start.to_numpy()).tolist()
                bounds = offsets.tolist()
                family.add([raw[s:e] for s, e in zip(seat, bounds[1:], strict=True)], [raw[a:s][::-1] for a, s in zip(bounds, seat, strict=False)])
                kept.append((k1, k2, place, single.to_numpy(zero_copy_only=False).astype(bool)))
        at = 0
        for k1, k2, place, single in kept:
            low, high = family.low[at : at + len(place)], family.high[at : at + len(place)]
            at += len(place)
            good = np.flatnonzero(single & (high >= 0))
            rows = pa.array(good)
            yield pa.RecordBatch.from_arrays([k1.take(rows), k2.take(rows), pa.array((place[good] - high[good]).astype(np.int32)), pa.array((place[good] - low[good] + length).astype(np.int32))], names=["k1", "k2", "start", "end"])
        trim()

    return entries.repartition(shards, "shard").select("k1", "k2", "place", "start", "single", "context").mapInArrow(run, "k1 long, k2 long, start int, end int")


def covered(docs: DataFrame, length: int, core: int, scratch: Scratch) -> DataFrame:
    """k1, k2, start, end: ranges of docs (k1, k2, text) that repeated strings cover."""
    hot = HOT
    one = F.count(F.lit(1))
    rows = scratch.keep(anchors(docs, length, core))
    seen = rows.groupBy("h").agg(one.alias("n"), *(f("c" + j).alias(a + j) for j in "12" for f, a in ((F.min, "a"), (F.max, "z")))).where("n > 1")
    seen = scratch.keep(seen.select("h", "n", F.expr("a1 <> z1 OR a2 <> z2").alias("varied")))
    again = scratch.keep(frequent_join(rows, seen, ["h"], "n").drop("n"))
    scratch.drop(rows)
    whole = again.where(~F.col("varied")).select("k1", "k2", "start", "end")
    varied = again.where("varied")
    kinds = scratch.keep(varied.groupBy("h", "c1", "c2").agg(one.alias("n"), F.min(F.struct("k1", "k2", "place", "start", "end")).alias("one")))
    twice = frequent_join(varied, kinds.where("n > 1").select("h", "c1", "c2", "n"), ["h", "c1", "c2"], "n").select("k1", "k2", "start", "end")
    per_anchor = scratch.keep(kinds.groupBy("h").agg(one.alias("contexts")))
    needed = frequent_join(kinds, per_anchor, ["h"], "contexts").select("one.*", "h", (F.col("n") == 1).alias("single"), "contexts")
    cut = _cut_contexts(needed, docs, length, core, hot)
    entries, ranges = [cut], [whole, twice]
    if not per_anchor.where(F.col("contexts") > hot).isEmpty():
        cut = scratch.keep(cut)
        narrow, more = _narrowed(cut.where("far >= 0"), length, hot, scratch)
        entries, ranges = [cut.where("far < 0"), *narrow], ranges + more
    shards = max(task_width(docs.sparkSession), -(-kinds.count() // SHARD))
    for e in entries[1:]:
        entries[0] = entries[0].unionByName(e)
    out = _family_matches(entries[0], length, core, shards)
    for r in ranges:
        out = out.unionByName(r)
    return out


def _joined(docs: DataFrame, min_bytes: int) -> tuple[DataFrame, str]:
    """docs with one more column, and its name: the covered ranges of each row's text, null where there are none."""
    length, core = min_bytes, max(4, min_bytes // 4)
    if length < 8:
        raise ValueError("min_bytes must be at least 8")
    k1, k2, p1, p2, held = (own_name(n) for n in ("k1", "k2", "p1", "p2", "ranges"))
    own = docs.withColumn(k1, F.xxhash64("doc_id", "text")).withColumn(k2, F.xxhash64(F.lit(17), "text", "doc_id"))
    texts = own.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), "text")
    ranges = covered(texts, length, core, Scratch(docs.sparkSession, "repeats"))
    per_doc = ranges.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias(held)).select(F.col("k1").alias(p1), F.col("k2").alias(p2), held)
    return own.join(per_doc, (F.col(k1) == F.col(p1)) & (F.col(k2) == F.col(p2)), "left").drop(k1, k2, p1, p2), held


def _kept(data: np.ndarray, offsets: np.ndarray, listed: pa.Array) -> Iterator[tuple[np.ndarray | None, memoryview]]:
    """Per text: which bytes are covered (None: none), and its bytes."""
    counts = listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = listed.flatten()
    start, end = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("start", "end"))
    raw, at = memoryview(data), 0
    for i, n in enumerate(counts):
        text = raw[offsets[i] : offsets[i + 1]]
        gone = None
        if n:
            edge = np.zeros(len(text) + 1, np.int32)
            np.add.at(edge, start[at : at + n], 1)
            np.subtract.at(edge, end[at : at + n], 1)
            gone = np.cumsum(edge[:-1]) > 0
            at += n
        yield gone, text


def _readable(gone: np.ndarray, text: memoryview) -> str:
    """The characters of a text of which no byte is covered."""
    data = np.frombuffer(text, np.uint8)
    start = np.flatnonzero((data & 0xC0) != 0x80)
    hurt = np.repeat(np.logical_or.reduceat(gone, start), np.diff(start, append=len(data)))
    return data[~hurt].tobytes().decode()


def remove_repeats(docs: DataFrame, min_bytes: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text of docs (doc_id, text).

    ``kept_sha256`` is that of the remaining bytes; ``text`` is what remains to be read: a character that loses a byte goes whole.
    """
    joined, held = _joined(docs.select("doc_id", "text"), min_bytes)
    joined = joined.select("doc_id", "text", held)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            removed, spans, digest, texts = [], [], [], []
            for gone, text in _kept(data, offsets, batch.column(2)):
                texts.append(bytes(text).decode() if gone is None else _readable(gone, text))
                kept = text if gone is None else np.frombuffer(text, np.uint8)[~gone].tobytes()
                spans.append(0 if gone is None else int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)))
                removed.append(len(text) - len(kept)), digest.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def strip_repeats(docs: DataFrame, min_bytes: int = 400) -> DataFrame:
    """docs without the covered bytes of their texts; a character that loses a byte goes whole.

    A text of which nothing is left goes as a row, one that was empty before stays. Columns are those of ``docs``; n_chars,
    where it is one, counts the new text.
    """
    names = docs.columns
    joined, held = _joined(docs, min_bytes)
    joined = joined.select(*[f"`{c}`" for c in names], held)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                data, offsets = text_buffer(batch.column(at))
                texts: list[bytes | str | None] = []
                for i, (gone, text) in enumerate(_kept(data, offsets, batch.column(len(names)))):
                    if gone is not None:
                        new = _readable(gone, text)
                        texts.append(new if new.strip() else None)
                    else:
                        texts.append(batch.column(at)[i].as_py())
                full = pa.array(texts, pa.string())
                stay = pa.array([t is not None or not g for t, g in zip(texts, batch.column(len(names)).value_lengths().fill_null(0).to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([full if j == at else batch.column(j) for j in range(len(names))], names=names).filter(stay)
        trim()

    out = joined.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out
