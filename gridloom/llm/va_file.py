"""Exact top-k inner-product search by vector-approximation files.

Equal vectors are one entry. Entries lie in chunks; a chunk's approximation holds, for each component, the number of its cell
on the chunk's own grid. The approximations are scanned twice: once for the k + 1 largest lower bounds of each query over all
chunks (a task keeps its own k + 1 and sends no more), once for the candidates whose upper bound reaches the last of these.
Exact vectors are then read in the order of the candidates' bounds, a lot per query and round, each twice the size of the one
before, until a query's next bound is below its last exact score. No vector is left out unless a bound proves that it can't enter.

Queries go to the tasks in groups of bounded bytes, one scan of the approximations a group: the stated query set against all
rows, in blocks.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors are padded with
zeros; rows that repeat an id or a vector are candidates of their own; ties go to the smaller id, null ids last; an empty table
or no query gives no rows; scores beyond a long are held at its ends; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import dense, exact_dot, matrix, members_of, nodes_of

CHUNK = 2048
BITS = 6
#: Bytes of a group of queries.
GROUP_BYTES = 8 << 20
#: Candidates that a query's first round reads, for each result.
FIRST_READ = 4


def _binary(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def approximations(nodes: DataFrame, width: int, bits: int) -> DataFrame:
    """chunk, uids, lo, step, codes: the approximation file."""

    def chunk(part: pa.RecordBatch, no: int) -> pa.RecordBatch:
        v = matrix(part.column(1), width)
        lo, hi = v.min(0), v.max(0)
        step = np.maximum((hi - lo) / (1 << bits), 1e-300)
        codes = np.minimum((v - lo) / step, (1 << bits) - 1).astype(np.uint8)
        uids = part.column(0).to_numpy().astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([int(uids[0])], pa.int64()), _binary([uids]), _binary([lo]), _binary([step]), _binary([codes])], names=["chunk", "uids", "lo", "step", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                yield chunk(batch.slice(at, CHUNK), at)

    return nodes.select("node", "v").mapInArrow(run, "chunk long, uids binary, lo binary, step binary, codes binary")


def bounds_scan(codes: np.ndarray, lo: np.ndarray, step: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of queries x candidates, with room for rounding."""
    base = queries @ lo
    c = codes.astype(np.float64)
    scaled = queries * step
    plus, minus = np.maximum(scaled, 0).sum(1), np.minimum(scaled, 0).sum(1)
    mid = scaled @ c.T + base[:, None]
    slack = 1e-9 * (np.abs(scaled) @ np.full(codes.shape[1], float(codes.max(initial=0)) + 1) + np.abs(queries) @ np.abs(lo) + 1)
    return mid + (minus - slack)[:, None], mid + (plus + slack)[:, None]


def _scan(approx: DataFrame, queries: tuple[np.ndarray, np.ndarray], width: int):
    """A function of (function of low, high, uids) that runs it over all approximations; bounds of queries x candidates."""
    shared = approx.sparkSession.sparkContext.broadcast(queries)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        vectors = shared.value[1]
        for batch in batches:
            for i in range(batch.num_rows):
                raw = [batch.column(j)[i].as_py() for j in range(4)]
                uids, lo, step = np.frombuffer(raw[0], np.int64), np.frombuffer(raw[1]), np.frombuffer(raw[2])
                codes = np.frombuffer(raw[3], np.uint8).reshape(-1, width)
                for a in range(0, len(vectors), 256):
                    yield (a, *bounds_scan(codes, lo, step, vectors[a : a + 256]), uids)

    return bounds


def _least_bounds(approx: DataFrame, queries: tuple[np.ndarray, np.ndarray], width: int, k: int) -> np.ndarray:
    """Per query of the group: its k-th largest lower bound over all candidates, -inf if there are fewer."""
    bounds, ids = _scan(approx, queries, width), queries[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(ids), k), -np.inf)
        for a, low, _, _ in bounds(batches):
            both = np.hstack([best[a : a + len(low)], low])
            best[a : a + len(low)] = -np.partition(-both, k - 1, axis=1)[:, :k]
        at, j = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(best[at, j])], names=["at", "low"])

    found = approx.select("uids", "lo", "step", "codes").mapInArrow(run, "at long, low double")
    order = Window.partitionBy("at").orderBy(F.col("low").desc())
    last = found.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("at", "low")
    out = np.full(len(ids), -np.inf)
    for r in last.collect():  # a number per query of a bounded group
        out[r["at"]] = r["low"]
    return out


def _candidates(approx: DataFrame, queries: tuple[np.ndarray, np.ndarray], least: np.ndarray, width: int) -> DataFrame:
    """q, c, high of all candidates whose upper bound reaches the query's ``least``."""
    bounds, ids = _scan(approx, queries, width), queries[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, _, high, uids in bounds(batches):
            r, c = np.nonzero(high >= least[a : a + len(high), None])
            yield pa.RecordBatch.from_arrays([pa.array(ids[a + r]), pa.array(uids[c]), pa.array(high[r, c])], names=["q", "c", "high"])

    return approx.select("uids", "lo", "step", "codes").mapInArrow(run, "q long, c long, high double")


def _scored(pairs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """q, c, score of pairs (q, c), from exact vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [pa.RecordBatch.from_arrays([batch.column(j).slice(at, 8192) for j in range(4)], names=["q", "c", "a", "b"]) for at in range(0, batch.num_rows, 8192)]
            for p in parts:
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(exact_dot(matrix(p.column(2), width), matrix(p.column(3), width)))], names=["q", "c", "score"])

    c = nodes.select(F.col("node").alias("c"), F.col("v").alias("b"))
    q = nodes.select(F.col("node").alias("q"), F.col("v").alias("a"))
    return pairs.join(c, "c").join(q, "q").select("q", "c", "a", "b").mapInArrow(run, "q long, c long, score long")


def _read_in_order(candidates: DataFrame, nodes: DataFrame, width: int, k: int, scratch: Scratch) -> DataFrame:
    """q, c, score of the candidates (q, c, high) that had to be read until every query's k-th score was certain."""
    by_high = Window.partitionBy("q").orderBy(F.col("high").desc(), "c")
    left = scratch.keep(candidates.withColumn("place", F.row_number().over(by_high)))
    done, lot, read = 0, FIRST_READ * k, None
    by_score = Window.partitionBy("q").orderBy(F.col("score").desc())
    while True:
        now = scratch.keep(_scored(left.where(F.col("place") <= done + lot).select("q", "c"), nodes, width))
        read = now if read is None else read.unionByName(now)
        done, lot = done + lot, 2 * lot
        sure = read.withColumn("n", F.row_number().over(by_score)).where(F.col("n") == k).select("q", F.col("score").alias("sure"))
        left = scratch.keep(left.where(F.col("place") > done).join(sure, "q").where(F.col("high") >= F.col("sure")).select("q", "c", "high", "place"))
        if left.isEmpty():
            return read


def top_k(table: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int, change=None, bits: int = BITS) -> DataFrame:
    """query_id, rank, <id_col>, score: each query row's k largest inner products over all other rows, exactly.

    ``is_query`` is a condition on the column ``id``; ``change`` maps the float64 matrix to integer values. A query's own row is
    among the k + 1 rows looked for; it goes at the end.
    """
    scratch = Scratch(table.sparkSession, "va")
    made, width = dense(table, id_col, vec_col, change)
    vectors = scratch.keep(made)
    nodes = scratch.keep(nodes_of(vectors))
    approx = scratch.keep(approximations(nodes, width, bits))
    asked = scratch.keep(vectors.where(is_query).join(nodes, "v").select(F.col("uid").alias("row"), F.col("id").alias("query_id"), F.col("node").alias("q")))
    queries = scratch.keep(nodes.join(asked.select(F.col("q").alias("node")).distinct(), "node").select("node", "v"))
    groups = max(1, -(-queries.count() * 8 * width // GROUP_BYTES))
    found = []
    for g in range(groups):
        rows = queries.where(F.pmod(F.xxhash64("node"), F.lit(groups)) == g).collect()
        if rows:
            group = np.array([r.node for r in rows], np.int64), np.array([np.frombuffer(r.v) for r in rows]).reshape(-1, width)
            found.append(scratch.keep(_candidates(approx, group, _least_bounds(approx, group, width, k + 1), width)))
    if not found:
        return asked.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias(id_col), F.lit(0).cast("long").alias("score")).limit(0)
    candidates = found[0]
    for f in found[1:]:
        candidates = candidates.unionByName(f)
    best = _read_in_order(candidates, nodes, width, k + 1, scratch)
    scored = best.join(members_of(vectors, nodes, k + 1), best["c"] == F.col("node")).select("q", "score", F.col("uid").alias("c"), F.col("id").alias("cid"))
    order = [F.col("score").desc(), F.col("cid").asc_nulls_last(), "c"]
    first = scored.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("n") <= k + 1).drop("n")
    other = first.join(asked, "q").where("row <> c")
    ranked = other.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("cid").alias(id_col), "score")
