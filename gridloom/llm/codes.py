"""Vector code compression: vectors cut into parts, each part replaced by the number of its codebook's nearest entry.

Codebooks are bounded (``parts`` x ``entries``), so each round broadcasts them as one kd-tree a codebook. Tasks search the trees
by branch and bound; a box as near as the best so far is visited too, so of equal distances the lower entry is found. Each
task sums the parts of every entry in integers, and Spark adds these sums: the driver sees ``parts * entries`` rows a round.

Defined cases: vectors that are null, empty or hold null or non-finite components are dropped; shorter vectors, and a length
that the parts don't divide, are filled up with zeros; numbers beyond +-2^26 are held to that, which keeps distances of up to 256
components exact; of equal ids the smaller vector comes first, null ids last; repeated rows count each; fewer vectors than
entries make smaller codebooks; an empty table gives an empty table; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frequent_join

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0
#: Entries that a leaf of a tree holds at most.
LEAF = 4
#: Vectors that are searched at once.
STEP_ROWS = 4096
#: Numbers are held to this size.
LIMIT = float(2**26)


class Tree:
    """A kd-tree over integer entries: boxes of all nodes; a leaf holds up to LEAF entries in the order of their numbers.

    Leaves with fewer entries repeat the last one, which changes no minimum.
    """

    def __init__(self, entries: np.ndarray):
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.child: list[tuple[int, int]] = []
        self.leaf: list[np.ndarray] = []
        self.depth = 1
        self._grow(entries, np.arange(len(entries)), 1)
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.child, self.leaf = np.array(self.child), np.array(self.leaf)
        self.entries = entries

    def _grow(self, entries: np.ndarray, members: np.ndarray, depth: int) -> int:
        at, points = len(self.low), entries[members]
        self.depth = max(self.depth, depth)
        self.low.append(points.min(0))
        self.high.append(points.max(0))
        self.child.append((-1, -1))
        self.leaf.append(np.pad(members[:LEAF], (0, max(0, LEAF - len(members))), mode="edge"))
        if len(members) > LEAF:
            axis = int(np.argmax(self.high[at] - self.low[at]))
            order = np.argsort(points[:, axis], kind="stable")
            half = len(members) // 2
            left = self._grow(entries, np.sort(members[order[:half]]), depth + 1)
            right = self._grow(entries, np.sort(members[order[half:]]), depth + 1)
            self.child[at] = (left, right)
        return at

    def bound(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The least squared distance of each x to its node's box."""
        gap = np.maximum(np.maximum(self.low[node] - x, x - self.high[node]), 0)
        return np.einsum("ij,ij->i", gap, gap)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of each row's nearest entry, the lower number of equals; and the leaves read."""
        n = len(x)
        best, found = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max)
        stack, bounds = np.zeros((n, self.depth + 1), np.int64), np.zeros((n, self.depth + 1), np.int64)
        top, read = np.ones(n, np.int64), 0
        bounds[:, 0] = self.bound(x, stack[:, 0])
        live = np.arange(n)
        while len(live):
            top[live] -= 1
            node, bound = stack[live, top[live]], bounds[live, top[live]]
            near = bound <= best[live]  # equal bounds too: an equal entry with a lower number may lie there
            rows, node = live[near], node[near]
            inner = self.child[node, 0] >= 0
            rows_in, kids = rows[inner], self.child[node[inner]]
            if len(rows_in):
                both = np.stack([self.bound(x[rows_in], kids[:, 0]), self.bound(x[rows_in], kids[:, 1])], 1)
                far = (both[:, 0] <= both[:, 1]).astype(np.int64)  # the farther child goes below the nearer one
                for side in (far, 1 - far):
                    pick = np.arange(len(rows_in)), side
                    stack[rows_in, top[rows_in]], bounds[rows_in, top[rows_in]] = kids[pick], both[pick]
                    top[rows_in] += 1
            at = rows[~inner]
            if len(at):
                read += len(at)
                held = self.leaf[node[~inner]]
                gap = self.entries[held] - x[at][:, None, :]
                distance = np.einsum("ijk,ijk->ij", gap, gap)
                first = distance.argmin(1)
                d, e = distance[np.arange(len(at)), first], held[np.arange(len(at)), first]
                better = (d < best[at]) | ((d == best[at]) & (e < found[at]))
                best[at[better]], found[at[better]] = d[better], e[better]
            live = live[top[live] > 0]
        return found, best, read


def integers(df: DataFrame, id_col: str, vec_col: str, *others: str, parts: int = PARTS, scale: float = SCALE) -> tuple[DataFrame, int]:
    """(id, v, others): floor(scale * component) of every vector that takes part, and the components of a part."""
    v = F.col(vec_col)
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    number = lambda x: F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), x.cast("double") * scale))).cast("long")
    kept = df.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).alias("id"), F.transform(v, number).alias("v"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(others)])
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    return kept, -(-longest // parts)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of ``width``, filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _assigned(trees: list[Tree], m: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, part, entries, squared distances), a step of rows at a time."""
    size = m.shape[1] // len(trees)
    for a in range(0, len(m), STEP_ROWS):
        for p, tree in enumerate(trees):
            entry, distance, _ = tree.nearest(np.ascontiguousarray(m[a : a + STEP_ROWS, p * size : (p + 1) * size]))
            yield a, p, entry, distance


def _updated(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: floor(sum / count) of the parts of every entry; unused ones stay."""
    parts, entries, size = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast([Tree(b) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), np.int64)
        for batch in batches:
            m = _matrix(batch.column(0), parts * size)
            for a, p, entry, _ in _assigned(shared.value, m):
                count[p] += np.bincount(entry, minlength=entries)
                np.add.at(total[p], entry, m[a : a + len(entry), p * size : (p + 1) * size])
        p, e = np.nonzero(count)
        sums = pa.array(total[p, e].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), sums], names=["p", "e", "n", "s"])

    sums = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
    rows = vectors.select("v").mapInArrow(run, "p int, e int, n long, s array<long>").groupBy("p", "e").agg(F.sum("n").alias("n"), *sums).collect()
    out = books.copy()
    for r in rows:
        out[r.p, r.e] = [int(r[f"s{i}"]) // r.n for i in range(size)]
    shared.unpersist()
    return out


def learned(vectors: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """(part, entry, component): codebooks that start at the vectors of the smallest ids and are updated ``rounds`` times."""
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    start = np.zeros((len(first), parts * size), np.int64)
    for row, r in zip(start, first, strict=True):
        row[: len(r.v)] = r.v
    books = np.ascontiguousarray(start.reshape(len(first), parts, size).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _updated(vectors, books)
    return books


def encode(vectors: DataFrame, books: np.ndarray, *others: str) -> DataFrame:
    """(id, others, code, error): two hex digits a part, and the squared distances of all parts, summed."""
    parts, _, size = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast([Tree(b) for b in books])
    names = ["id", *others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.frombuffer(b"".join(b"%02x" % i for i in range(256)), np.uint8).reshape(256, 2)
        for batch in batches:
            m = _matrix(batch.column(len(names)), parts * size)
            code, error = np.zeros((len(m), parts), np.int64), np.zeros(len(m), np.int64)
            for a, p, entry, distance in _assigned(shared.value, m):
                code[a : a + len(entry), p] = entry
                error[a : a + len(entry)] += distance
            offsets = np.arange(len(m) + 1, dtype=np.int32) * (2 * parts)
            text = pa.Array.from_buffers(pa.string(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(digits[code].tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], text, pa.array(error)], names=[*names, "code", "error"])

    kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in names)
    return vectors.select(*names, "v").mapInArrow(run, f"{kinds}, code string, error long")


def decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors of entries that codes (row, part) stand for."""
    parts, _, size = books.shape
    return books[np.arange(parts)[None, :], codes].reshape(len(codes), parts * size)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(df: DataFrame, id_col: str, vec_col: str, label_col: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """id, code, error, label_error (error summed over the rows of one label, null being one) and codebooks_sha256."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    scratch = Scratch(df.sparkSession, "codes")
    vectors, size = integers(df, id_col, vec_col, label_col, parts=parts)
    if not size:
        return vectors.select("id", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256")).where("false")
    books = learned(vectors, size, parts, entries, rounds)
    coded = scratch.keep(encode(vectors, books, "o0")).withColumn("label", F.to_json(F.struct("o0")))
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count(F.lit(1)).alias("rows"))
    return frequent_join(coded, sums, ["label"], "rows").select("id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
