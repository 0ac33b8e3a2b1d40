"""Approximate nearest neighbours by largest inner product: NN-descent builds a neighbour graph, greedy graph search answers.

Equal vectors are one node. One more component gives all nodes the same length, so that the nearest by inner product are the
nearest in space. Random hyperplane trees, fitted on a bounded sample, deal the nodes to small blocks whose members are
compared: the first neighbours. Then NN-descent: each round joins, in Spark, every node's neighbours and reverse neighbours
with each other and keeps what is nearer than a node's last neighbour. A search starts at a query's own node and the graph's
entry nodes, expands the best nodes not yet expanded, a beam per query and a join per round, until next to none is left open. The
recall of a bounded sample of the queries is then measured against brute force; while it is too low, beam and entry nodes
double and the search goes on from where it ended; before a beam holds a quarter of all nodes, the queries are compared with
all of them, a group of queries after another. The beam is scored again with the original vectors in double precision.

Every row is indexed. Bounds (neighbours per node, reverse neighbours, block size) are parameters of the index and don't
depend on the number of rows; the beam is what the measured recall asks for. Descent and search go on until they change nothing
more, or too little. Recall is stated in the README and tested.

Defined cases: extra columns, whatever their names, are ignored; vectors that are null, zero or hold null or non-finite
components take no part; shorter vectors are padded with
zeros; rows that repeat an id or a vector are candidates of their own; ties go to the smaller id, null ids last; fewer than k
candidates give all of them; an empty table or no query gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_buffer
from .vectors import dense, matrix, members_of, nodes_of

NEIGHBOURS = 32
TREES = 8
BLOCK = 1024
#: Rows of the sample that trees are fitted on.
SAMPLE = 16_384
#: Blocks of a leaf that one task splits further by itself.
SPLIT = 64
#: A round that changes fewer of the neighbours than this ends the descent.
SETTLED = 0.05
BEST = 8
#: The first beam holds so many nodes for each doubling of the number of nodes, as a search's depth grows with it.
BEAM = 16
#: Recall at which the beam is wide enough, and the queries that it is measured on.
RECALL = 0.95
PROBES = 256
#: Nodes of a beam that one round expands, and the least share of the beam.
EXPANDED, EXPANDED_SHARE = 96, 3
ENTRIES = 16
#: A search is done when open nodes are fewer than this share of its queries: what the last rounds would find is found by few.
DONE = 0.1
#: Where a beam would hold more than this part of the nodes, queries are compared with all of them.
ALL_SHARE = 4


def _rows(batch: pa.RecordBatch, column: int, dtype: str, width: int) -> np.ndarray:
    return text_buffer(batch.column(column))[0].view(dtype).reshape(-1, width)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    size = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def _small(vectors: DataFrame, width: int, length: float) -> DataFrame:
    """node, x, x8: vectors of unit length with one more component, in half precision and in 8 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1), width) / length
            more = np.sqrt(np.maximum(0, 1 - (v * v).sum(1, keepdims=True)))
            x = np.hstack([v, more])
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(x.astype(np.float16)), _binary(np.rint(x * 127).astype(np.int8))], names=["node", "x", "x8"])

    return vectors.select("node", "v").mapInArrow(run, "node long, x binary, x8 binary")


def grow_tree(sample: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Planes and cuts of a complete tree: each cut is the sample's median along the line between two of its points."""
    r = np.random.default_rng(seed)
    planes, cuts = np.zeros((2**depth, sample.shape[1]), np.float32), np.zeros(2**depth, np.float32)
    rows = {1: np.arange(len(sample))}
    for node in range(1, 2**depth):
        own = rows.pop(node)
        a, b = r.integers(0, len(own), 2) if len(own) else (0, 0)
        plane = sample[own[a]] - sample[own[b]] if len(own) > 1 and a != b else r.normal(size=sample.shape[1])
        if not np.any(plane):
            plane = r.normal(size=sample.shape[1])
        at = sample[own] @ plane
        planes[node], cuts[node] = plane, np.median(at) if len(own) else 0
        rows[2 * node], rows[2 * node + 1] = own[at <= cuts[node]], own[at > cuts[node]]
    return planes, cuts


def _blocks(small: DataFrame, width: int, trees: list, scratch: Scratch) -> DataFrame:
    """key, part, node, x of every node in every tree; a leaf larger than a task splits is dealt to several by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch, 1, "f2", width).astype(np.float32)
            for t, (planes, cuts) in enumerate(trees):
                at = np.ones(len(x), np.int64)
                while len(cuts) > 1 and len(at) and at[0] < len(cuts):
                    at = 2 * at + (np.einsum("ij,ij->i", x, planes[at]) > cuts[at])
                yield pa.RecordBatch.from_arrays([pa.array(at * len(trees) + t), batch.column(0), batch.column(1)], names=["key", "node", "x"])

    leaves = scratch.keep(small.select("node", "x").mapInArrow(run, "key long, node long, x binary"))
    parts = leaves.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (SPLIT * BLOCK)).alias("parts"))
    return leaves.join(parts, "key").select("key", F.pmod(F.xxhash64("node", "key"), "parts").alias("part"), "node", "x")


def halves(x: np.ndarray, seed: int) -> Iterator[np.ndarray]:
    """Rows of x in groups of at most a block, by medians along lines between two of a group's points."""
    r, todo = np.random.default_rng(seed), [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= BLOCK:
            yield own
            continue
        a, b = r.choice(len(own), 2, replace=False)
        order = np.argsort(x[own] @ (x[own[a]] - x[own[b]]), kind="stable")
        todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]


def _in_blocks(blocks: DataFrame, width: int, k: int) -> DataFrame:
    """node, other, score: each node's nearest in its block."""

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        nodes = block.column("node").to_numpy()
        x = text_buffer(block.column("x"))[0].view("f2").reshape(-1, width).astype(np.float32)
        out = []
        for rows in halves(x, len(nodes)):
            own, y = nodes[rows], x[rows]
            s = y @ y.T
            np.fill_diagonal(s, -np.inf)
            n = min(k, len(own) - 1)
            if n > 0:
                best = np.argpartition(-s, n - 1, axis=1)[:, :n]
                out.append((np.repeat(own, n), own[best].ravel(), np.take_along_axis(s, best, 1).ravel()))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)]
        return pa.table({"node": pa.array(cols[0], pa.int64()), "other": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float32())})

    return blocks.groupBy("key", "part").applyInArrow(run, "node long, other long, score float")


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k best distinct neighbours of each node; ``fresh`` stays only where every copy of an edge is fresh."""
    dealt = edges.repartition("node")
    each = dealt.groupBy("node", "other").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("node").orderBy(F.col("score").desc(), F.xxhash64("node", "other"))  # near copies score alike: no few of them may be everyone's neighbours
    return each.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def _join_round(graph: DataFrame, small: DataFrame, width: int, k: int, round_: int) -> DataFrame:
    """node, other, score: pairs of neighbours of one node that are nearer than the node's last neighbour."""
    last = graph.groupBy("node").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).select(F.col("node").alias("other"), F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(-2.0)).cast("float").alias("least"))
    both = graph.select("node", "other", "fresh").unionByName(graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "fresh"))
    order = Window.partitionBy("node").orderBy(F.col("fresh").desc(), F.xxhash64("other", F.lit(round_)))
    lists = both.groupBy("node", "other").agg(F.min("fresh").alias("fresh")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + k // 2).drop("n")
    known = small.join(last, small["node"] == last["other"]).select("other", "x8", "least")
    full = lists.join(known, "other").groupBy("node").agg(F.collect_list(F.struct("other", "fresh", "least", "x8")).alias("l"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.column(0).slice(at, 500)
                counts = part.value_lengths().to_numpy()
                flat = part.flatten()
                other, fresh, least = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("other", "fresh", "least"))
                x = text_buffer(flat.field("x8"))[0].view(np.int8).reshape(-1, width).astype(np.float32) / 127
                m = int(counts.max())
                row = np.repeat(np.arange(len(counts)), counts)
                col = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                cube = np.zeros((len(counts), m, width), np.float32)
                ids, new, worst = np.full((len(counts), m), -1), np.zeros((len(counts), m), bool), np.full((len(counts), m), 9.0, np.float32)
                cube[row, col], ids[row, col], new[row, col], worst[row, col] = x, other, fresh, least
                s = cube @ cube.transpose(0, 2, 1)
                good = (ids[:, :, None] >= 0) & (ids[:, None, :] >= 0) & (ids[:, :, None] != ids[:, None, :]) & (new[:, :, None] | new[:, None, :]) & (s > worst[:, :, None])
                s = np.where(good, s, -9)
                n = min(BEST, m)
                best = np.argpartition(-s, n - 1, axis=2)[:, :, :n]
                value = np.take_along_axis(s, best, 2)
                i, j, z = np.nonzero(value > -9)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i, j], pa.int64()), pa.array(ids[i, best[i, j, z]], pa.int64()), pa.array(value[i, j, z].astype(np.float32))], names=["node", "other", "score"])

    return full.select("l").mapInArrow(run, "node long, other long, score float").groupBy("node", "other").agg(F.max("score").alias("score"))


def build_graph(small: DataFrame, width: int, n: int, scratch: Scratch, k: int = NEIGHBOURS) -> DataFrame:
    """node, other, score: about k nearest neighbours of every node."""
    sample = np.array([np.frombuffer(r.x, "f2") for r in small.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect()], np.float32).reshape(-1, width)
    depth = max(0, min(int(np.ceil(np.log2(max(1, n / (BLOCK * 0.7))))), int(np.log2(max(1, len(sample) / 8)))))
    trees = [grow_tree(sample, depth, seed) for seed in range(TREES)]
    first = _in_blocks(_blocks(small, width, trees, scratch), width, k // 2)
    graph = scratch.keep(_nearest(first.withColumn("fresh", F.lit(True)), k))
    changed, round_ = n * k, 0
    while changed >= SETTLED * n * k:
        found = _join_round(graph, small, width, k, round_).withColumn("fresh", F.lit(True))
        new = scratch.keep(_nearest(graph.withColumn("fresh", F.lit(False)).unionByName(found), k))
        scratch.drop(graph)
        graph, changed, round_ = new, new.where("fresh").count(), round_ + 1
    return graph


def _expand(steps: DataFrame, lists: DataFrame, width: int) -> DataFrame:
    """q, node, score of the neighbours, nearer than ``least``, of the nodes that ``steps`` (q, node, qx, least) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counts = part.column(3).value_lengths().to_numpy()
                x = text_buffer(part.column(4).flatten())[0].view(np.int8).reshape(-1, width).astype(np.float32) / 127
                q = _rows(part, 1, "f2", width).astype(np.float32)
                row = np.repeat(np.arange(len(counts)), counts)
                score = np.einsum("ij,ij->i", x, q[row]).astype(np.float32)
                qs, nodes = part.column(0).to_numpy()[row], part.column(3).flatten().to_numpy()
                good = np.flatnonzero(score > part.column(2).to_numpy()[row])
                order = good[np.lexsort((nodes[good], qs[good]))]  # expanded nodes share neighbours
                new = np.ones(len(order), bool)
                new[1:] = (nodes[order][1:] != nodes[order][:-1]) | (qs[order][1:] != qs[order][:-1])
                order = order[new]
                yield pa.RecordBatch.from_arrays([pa.array(qs[order], pa.int64()), pa.array(nodes[order], pa.int64()), pa.array(score[order])], names=["q", "node", "score"])

    return steps.join(lists, "node").select("q", "qx", "least", "others", "xs").mapInArrow(run, "q long, node long, score float")


def _neighbour_lists(graph: DataFrame, small: DataFrame, k: int) -> DataFrame:
    """node, others, xs: neighbours and up to k reverse neighbours, with their vectors in 8 bits."""
    order = Window.partitionBy("node").orderBy(F.col("score").desc(), F.xxhash64("node", "other"))
    back = graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "score").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")
    both = graph.select("node", "other", "score").unionByName(back).groupBy("node", "other").agg(F.max("score").alias("score"))
    full = both.join(small.select(F.col("node").alias("other"), "x8"), "other").groupBy("node").agg(F.collect_list(F.struct("other", "x8")).alias("l"))
    return full.select("node", F.col("l.other").alias("others"), F.col("l.x8").alias("xs"))


def search(queries: DataFrame, lists: DataFrame, small: DataFrame, width: int, scratch: Scratch, beam: int, entries: int = ENTRIES, known: DataFrame | None = None) -> DataFrame:
    """q, node, score, open: for queries (q, qx, node: where to start) the beam that greedy search ends with; ``known`` is a narrower beam's."""
    first = small.orderBy(F.xxhash64("node", F.lit(5)), "node").limit(entries).select("node")
    starts = queries.select("q", "node").unionByName(queries.select("q").join(F.broadcast(first), F.lit(True))).distinct().withColumn("score", F.lit(-1.5).cast("float"))
    if known is not None:
        starts = starts.unionByName(known.select("q", "node", "score")).groupBy("q", "node").agg(F.max("score").alias("score"))
    state = scratch.keep(starts.withColumn("open", F.lit(True)))
    expanded, enough = max(EXPANDED, beam // EXPANDED_SHARE), int(DONE * queries.count())
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "node")
    next_ = Window.partitionBy("q").orderBy(F.col("open").desc(), F.col("score").desc(), "node")
    all_ = Window.partitionBy("q")
    while True:
        least = F.when(F.count(F.lit(1)).over(all_) >= beam, F.min("score").over(all_)).otherwise(F.lit(-2.0)).cast("float")
        chosen = state.withColumns({"n": F.row_number().over(next_), "least": least}).withColumn("now", F.col("open") & (F.col("n") <= expanded)).drop("n")
        steps = chosen.where("now").select("q", "node", "least").join(queries.select("q", "qx"), "q")
        found = _expand(steps, lists, width).withColumn("open", F.lit(True))
        left = chosen.select("q", "node", "score", (F.col("open") & ~F.col("now")).alias("open"))
        both = left.unionByName(found).repartition("q")  # a query's beam and what it found: merged and cut where they lie
        merged = both.groupBy("q", "node").agg(F.max("score").alias("score"), F.min("open").alias("open"))
        new = scratch.keep(merged.withColumn("n", F.row_number().over(order)).where(F.col("n") <= beam).drop("n"))
        scratch.drop(state)
        state = new
        if state.where("open").count() <= enough:
            return state


def _compared_with_all(asked: DataFrame, nodes: DataFrame, width: int, k: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """A bounded number of queries (q, node, v), their vectors, and (at, node, score): the k best other nodes of each, by number."""
    rows = asked.select("q", "node", "v").collect()
    qs, own = (np.array([r[c] for r in rows], np.int64) for c in ("q", "node"))
    v = np.array([np.frombuffer(r.v, np.float64) for r in rows]).reshape(-1, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, ids = np.full((len(qs), 0), -np.inf), np.zeros((len(qs), 0), np.int64)
        for batch in batches:
            s, node = v @ matrix(batch.column(1), width).T, batch.column(0).to_numpy()
            s[own[:, None] == node[None, :]] = -np.inf
            best, ids = np.hstack([best, s]), np.hstack([ids, np.broadcast_to(node, s.shape)])
            if best.shape[1] > k:
                top = np.argpartition(-best, k - 1, axis=1)[:, :k]
                best, ids = np.take_along_axis(best, top, 1), np.take_along_axis(ids, top, 1)
        at, j = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ids[at, j], pa.int64()), pa.array(best[at, j])], names=["at", "node", "score"])

    order = Window.partitionBy("at").orderBy(F.col("score").desc(), "node")
    return qs, v, nodes.select("node", "v").mapInArrow(run, "at long, node long, score double").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def _all_nodes(asked: DataFrame, nodes: DataFrame, width: int, k: int, scratch: Scratch) -> DataFrame:
    """q, node, score of each query's nearest by comparison with every node: groups of queries against all rows."""
    groups, out = max(1, -(-asked.count() // PROBES)), None
    for g in range(groups):
        qs, _, top = _compared_with_all(asked.where(F.pmod(F.xxhash64("q"), F.lit(groups)) == g), nodes, width, k)
        part = top.select(F.element_at(F.array(*[F.lit(int(q)) for q in qs]), (F.col("at") + 1).cast("int")).alias("q"), "node", F.col("score").cast("float").alias("score")) if len(qs) else None
        out = part if out is None else out if part is None else out.unionByName(part)
    return scratch.keep(out)


def _probes(asked: DataFrame, nodes: DataFrame, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a sample of the queries: q, vector, how many nodes its recall counts (k, or all others), and the last one's score."""
    qs, v, top = _compared_with_all(asked.orderBy(F.xxhash64("q", F.lit(9)), "q").limit(PROBES), nodes, width, k)
    wanted, last = np.zeros(len(qs), np.int64), np.zeros(len(qs))
    for r in top.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last")).collect():
        wanted[r["at"]], last[r["at"]] = r["n"], r["last"]
    return qs, v, wanted, last


def _recall(beams: DataFrame, queries: DataFrame, nodes: DataFrame, width: int, probes: tuple) -> float:
    """The share of the probes' nearest nodes that their beams hold; of nodes with equal scores any counts."""
    qs, v, wanted, last = probes
    order = np.argsort(qs)
    sorted_ = qs[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = order[np.searchsorted(sorted_, batch.column(0).to_numpy())]
            s = np.einsum("ij,ij->i", v[at], matrix(batch.column(1), width))
            good = s >= last[at] - 1e-9 * np.abs(last[at])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good))], names=["q"])

    held = beams.where(F.col("q").isin(qs.tolist())).select("q", "node").join(queries.select("q", F.col("node").alias("own")), "q").where("node <> own")
    found = {r.q: r.n for r in held.join(nodes, "node").select("q", "v").mapInArrow(run, "q long").groupBy("q").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sum(min(found.get(q, 0), n) for q, n in zip(qs.tolist(), wanted.tolist(), strict=True)) / max(1, int(wanted.sum()))


def search_to_recall(queries: DataFrame, asked: DataFrame, nodes: DataFrame, graph: DataFrame, small: DataFrame, width: int, n: int, k: int, scratch: Scratch) -> DataFrame:
    """q, node, score: beams as wide as the recall at k of a sample of the queries asks for, or, in the end, the nearest of all nodes."""
    lists = scratch.keep_by(_neighbour_lists(graph, small, NEIGHBOURS), "node")
    probes = _probes(asked, nodes, width, k)
    beam, entries, beams = max(4 * k, BEAM * int(np.ceil(np.log2(n + 1)))), ENTRIES, None
    while True:
        wider = search(queries, lists, small, width + 1, scratch, beam, entries, beams)
        if beams is not None:
            scratch.drop(beams)
        beams, recall = wider, _recall(wider, queries, nodes, width, probes)
        if recall >= RECALL:
            break
        beam, entries = 2 * beam, 2 * entries
        if beam > n // ALL_SHARE:
            scratch.drop(beams)
            beams = _all_nodes(asked, nodes, width, k, scratch)
            break
    scratch.drop(lists)
    return beams.select("q", "node", "score")


def nearest(table: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, <id_col>, score: each query row's k nearest other rows found. ``is_query`` is a condition on the column ``id``."""
    scratch = Scratch(table.sparkSession, "nn")
    made, width = dense(table, id_col, vec_col, drop_zero=True)
    vectors = scratch.keep(made)
    nodes = scratch.keep(nodes_of(vectors))
    n = nodes.count()
    if n == 0:
        return vectors.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(id_col), F.lit(0.0).alias("score")).limit(0)
    length = _longest(nodes, width)
    small = scratch.keep(_small(nodes, width, length))
    graph = build_graph(small, width + 1, n, scratch)
    asked = vectors.where(is_query).join(nodes, "v").select(F.col("uid").alias("q"), "node", "v")
    queries = scratch.keep(_asked(asked, width))
    beams = search_to_recall(queries, asked, nodes, graph, small, width, n, k, scratch)
    members = members_of(vectors, nodes, k + 1).join(nodes, "node").select("node", F.col("uid").alias("c"), F.col("id").alias("cid"), F.col("v").alias("b"))
    own = queries.select("q", "node").withColumn("score", F.lit(2.0).cast("float"))
    pairs = beams.unionByName(own).select("q", "node").distinct().join(members, "node").where("q <> c")
    ids = vectors.select(F.col("uid").alias("q"), F.col("id").alias("query_id"), F.col("v").alias("a"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.einsum("ij,ij->i", matrix(batch.column(4), width), matrix(batch.column(5), width))
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(4)), pa.array(s)], names=["q", "query_id", "c", "cid", "score"])

    kind = table.schema[id_col].dataType.simpleString()
    scored = pairs.join(ids, "q").select("q", "query_id", "c", "cid", "a", "b").mapInArrow(exact, f"q long, query_id {kind}, c long, cid {kind}, score double")
    last = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("cid").asc_nulls_last(), "c")
    return scored.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("cid").alias(id_col), "score")


def _longest(nodes: DataFrame, width: int) -> float:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(0), width)
            yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((v * v).sum(1).max(initial=0)))])], names=["s"])

    return float(nodes.select("v").mapInArrow(run, "s double").agg(F.max("s")).first()[0])


def _asked(asked: DataFrame, width: int) -> DataFrame:
    """q, node, qx: queries of unit length, their extra component 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(2), width)
            v = v / np.sqrt((v * v).sum(1, keepdims=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(np.hstack([v, np.zeros((len(v), 1))]).astype(np.float16))], names=["q", "node", "qx"])

    return asked.select("q", "node", "v").mapInArrow(run, "q long, node long, qx binary")
