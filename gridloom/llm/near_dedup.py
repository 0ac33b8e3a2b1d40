"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

A text's weighted set holds its five-word shingles, weighted by how often they occur. Each element sends arrivals of a Poisson
process whose rate is its weight; an arrival falls into a random register, which keeps its earliest element, and an element
stops once its next arrival comes later than every register's (early termination). Two signatures agree in a register with
the probability Jaccard similarity of the two sets. Bands of registers give candidates; these are verified with the exact
similarity of the whole sets, and verified links make classes.

Texts with equal weighted sets are one node from the start. In a bucket, nodes are compared with its least node, not with each
other. Where a bucket's nodes are then still in different components, those outside the largest one are compared with all
others, block by block, so no link between nodes that share a bucket is lost and no list of all pairs is made.

Defined cases: null, empty and blank texts have no shingles and are classes of their own; texts of fewer than five words are
one shingle, very long ones are signed whole; rows that repeat are members of one class; a null doc_id is kept, and a class is
named by its least non-null id; an empty table gives no rows; extra columns, whatever their names, are ignored or passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Scratch, frequent_join, own_name, slices, text_buffer, trim
from .components import components
from .hashing import mixed, word_hashes
from .tokens import _KIND, _LOWER, SPACE

WORDS = 5
BANDS, ROWS = 24, 6
THRESHOLD = 0.8
#: Bits of a shingle's hash.
BITS = 44
#: Bytes of sets on either side of a block of comparisons.
BLOCK_BYTES = 4 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight) of texts, sorted by row and shingle."""
    n = len(data)
    solid = _KIND[data] != SPACE
    begin = np.zeros(n + 1, bool)
    begin[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    first = solid & (~before | begin[:n])
    last = np.zeros(n, bool)
    if n:
        last[:-1] = solid[:-1] & (~solid[1:] | begin[1:n])
        last[-1] = solid[-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = word_hashes(_LOWER[data], start, end)
    bounds = np.searchsorted(start, offsets)
    count = np.diff(bounds)
    row = np.repeat(np.arange(len(count)), count)
    total = np.zeros(len(h), np.uint64)
    left = bounds[row + 1] - np.arange(len(h))
    for j in range(words):  # words beyond a short text's end add nothing
        part = np.zeros(len(h), np.uint64)
        part[: max(0, len(h) - j)] = h[j:]
        total += np.where(left > j, part * np.uint64(2 * 0x1F3D5B79 * (j + 1) + 1), np.uint64(0))
        total = (total << np.uint64(7)) ^ (total >> np.uint64(57)) if j < words - 1 else total
    keep = (left >= words) | ((np.arange(len(h)) == bounds[row]) & (count[row] < words))
    shingle = mixed(total[keep]) >> np.uint64(64 - BITS)
    out: list[tuple[np.ndarray, ...]] = []
    rows = row[keep]
    group = 1 << (64 - BITS)
    for lo in range(0, len(count), group):
        a, b = np.searchsorted(rows, [lo, lo + group])
        key, weight = np.unique((rows[a:b] - lo).astype(np.uint64) << np.uint64(BITS) | shingle[a:b], return_counts=True)
        out.append(((key >> np.uint64(BITS)).astype(np.int64) + lo, key & np.uint64((1 << BITS) - 1), weight))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, registers: int) -> np.ndarray:
    """rows x registers ProbMinHash signatures; rows without elements hold zeros."""
    times = np.full(rows * registers, np.inf)
    out = np.zeros(rows * registers, np.uint64)
    size = np.bincount(row, minlength=rows)
    lone = size[row] == 1
    out.reshape(rows, registers)[row[lone]] = element[lone, None]
    live = np.flatnonzero(~lone)
    row, element, rate = row[live], element[live], weight[live].astype(float)
    at = np.zeros(len(row))
    arrival = 0
    while len(row):
        arrival += 1
        u = mixed(element * np.uint64(0x9E3779B97F4A7C15) + np.uint64(arrival * 0x632BE59BD9B4E019 % 2**64))
        at = at - np.log((u >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54) / rate
        place = row * registers + (mixed(u) >> np.uint64(32)).astype(np.int64) % registers
        better = at < times[place]
        p, t = place[better], at[better]
        np.minimum.at(times, p, t)
        won = times[p] == t
        out[p[won]] = element[better][won]
        latest = times.reshape(rows, registers).max(1)
        going = at < latest[row]
        row, element, rate, at = row[going], element[going], rate[going], at[going]
    return out.reshape(rows, registers)


def digests(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's weighted set."""
    out = []
    for seed in (3, 5):
        x = mixed(mixed(element + np.uint64(seed)) ^ (weight.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        total = np.zeros(rows, np.uint64)
        np.add.at(total, row, x)
        out.append(mixed(total).view(np.int64))
    return out[0], out[1]


def signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, k1, k2, d1, d2, bands of docs (doc_id, k1, k2, text); bands is null where there are no shingles."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            data, offsets = text_buffer(batch.column(3))
            for a, b in slices(offsets, SLICE_BYTES // 4):
                row, element, weight = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                n = b - a
                sig = signatures(row, element, weight, n, bands * rows)
                d1, d2 = digests(row, element, weight, n)
                keys = mixed(sig.reshape(n, bands, rows) * spread).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)
                keys = mixed(keys).view(np.int64)
                empty = np.bincount(row, minlength=n) == 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands), pa.int32()), pa.array(keys.ravel()))
                lists = pc.if_else(pa.array(empty), pa.scalar(None, lists.type), lists)
                yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(a, n) for j in range(3)), pa.array(d1), pa.array(d2), lists], names=["doc_id", "k1", "k2", "d1", "d2", "bands"])
        trim()

    return docs.select("doc_id", "k1", "k2", "text").mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, d1 long, d2 long, bands array<long>")


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard similarity of two weighted sets (sorted elements, weights)."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = wa[i].astype(float), wb[j].astype(float)
    ratio = y / x
    rest_a, rest_b = float(wa.sum()) - x.sum(), float(wb.sum()) - y.sum()
    total = 0.0
    for r in np.unique(ratio):
        total += x[ratio == r].sum() / (np.maximum(x, y / r).sum() + rest_a + rest_b / r)
    return total


def _sets(nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """node, elements, weights of nodes (node, k1, k2), from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in slices(offsets, SLICE_BYTES // 4):
                row, element, weight = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                cut = np.searchsorted(row, np.arange(b - a + 1)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([element[x:y].tobytes() for x, y in zip(cut, cut[1:], strict=False)], pa.binary()), pa.array([weight[x:y].astype(np.int32).tobytes() for x, y in zip(cut, cut[1:], strict=False)], pa.binary())],
                    names=["node", "elements", "weights"],
                )
        trim()

    texts = docs.join(nodes, ["k1", "k2"]).select("node", "text")
    return texts.mapInArrow(run, "node long, elements binary, weights binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, sim of pairs (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = []
            for ea, wa, eb, wb in zip(*(batch.column(j) for j in range(2, 6)), strict=True):
                sims.append(similarity(np.frombuffer(ea.as_buffer(), np.uint64), np.frombuffer(wa.as_buffer(), np.int32), np.frombuffer(eb.as_buffer(), np.uint64), np.frombuffer(wb.as_buffer(), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["a", "b", "sim"])
        trim()

    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea"), F.col("weights").alias("wa"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"), F.col("weights").alias("wb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ea", "wa", "eb", "wb").mapInArrow(run, "a long, b long, sim double")


def _family_links(buckets: DataFrame, roots: DataFrame, sets: DataFrame, threshold: float, scratch: Scratch) -> DataFrame | None:
    """Links (a, b) between members of one bucket that are still in different components; None if no bucket has such.

    Buckets that share members make a family. All its members outside its largest component are compared with all its
    members of other components, in blocks of bounded bytes: a member's set is sent once for each block it meets, and only
    links leave a block.
    """
    rooted = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = rooted.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("bucket")
    held = scratch.keep(rooted.join(open_, "bucket").select("node", "pivot", "root"))
    if held.isEmpty():
        return None
    family = components(held.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")), scratch)
    nodes = held.select("node", "root").distinct().join(family.select("node", F.col("root").alias("family")), "node", "left").withColumn("family", F.coalesce("family", "node"))
    full = scratch.keep(nodes.join(sets, "node"))
    sizes = full.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("elements")).alias("bytes"))
    whole = sizes.groupBy("family").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("big"), F.sum("bytes").alias("bytes"), F.max_by("bytes", F.struct("n", -F.col("root"))).alias("big_bytes"), F.sum("n").alias("members"))
    part = lambda c: F.greatest(F.lit(1), F.ceil(c / BLOCK_BYTES)).cast("int")
    whole = scratch.keep(whole.select("family", "big", part(F.col("bytes") - F.col("big_bytes")).alias("zs"), part(F.col("bytes")).alias("xs"), "members"))
    dealt = frequent_join(full, whole, ["family"], "members").withColumn("h", F.xxhash64("node"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    z = dealt.where("root <> big").withColumn("z", F.pmod("h", "zs").cast("int")).withColumn("x", F.explode(every(F.col("xs")))).withColumn("asks", F.lit(True))
    x = dealt.withColumn("x", F.pmod("h", "xs").cast("int")).withColumn("z", F.explode(every(F.col("zs")))).withColumn("asks", F.lit(False))
    columns = ["family", "z", "x", "asks", "node", "root", "elements", "weights"]

    def run(block: pa.Table) -> pa.Table:
        asks = block.column("asks").to_numpy(zero_copy_only=False)
        node, root = (block.column(c).to_numpy() for c in ("node", "root"))
        sets_ = [(np.frombuffer(e.as_buffer(), np.uint64), np.frombuffer(w.as_buffer(), np.int32)) for e, w in zip(block.column("elements"), block.column("weights"), strict=True)]
        others = np.flatnonzero(~asks)
        out: list[tuple[int, int]] = []
        if len(others) and asks.any():
            count = np.array([len(sets_[i][0]) for i in others])
            element, weight = np.concatenate([sets_[i][0] for i in others]), np.concatenate([sets_[i][1] for i in others])
            owner = np.repeat(np.arange(len(others)), count)
            total = np.bincount(owner, weight, len(others))
            plain = np.array([bool((sets_[i][1] == 1).all()) for i in others])
            order = np.argsort(element, kind="stable")
            element, weight, owner = element[order], weight[order], owner[order]
            for i in np.flatnonzero(asks):
                e, w = sets_[i]
                lo, hi = np.searchsorted(element, e, "left"), np.searchsorted(element, e, "right")
                n = hi - lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                o = owner[at]
                mine, theirs = np.bincount(o, np.repeat(w, n), len(others)), np.bincount(o, weight[at], len(others))
                # the similarity is at most either set's share of weight in common
                may = (mine >= threshold * w.sum() - 1e-9) & (theirs >= threshold * total - 1e-9) & (root[others] != root[i])
                done: set[int] = set()
                flat = bool((w == 1).all())
                for j in np.flatnonzero(may):
                    k = others[j]
                    if int(root[k]) not in done:
                        sim = mine[j] / (len(e) + total[j] - mine[j]) if flat and plain[j] else similarity(e, w, *sets_[k])
                        if sim >= threshold:
                            done.add(int(root[k]))
                            out.append((int(node[i]), int(node[k])))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    blocks = z.select(columns).unionByName(x.select(columns)).repartition("family", "z", "x")  # a family's blocks go to different tasks
    return blocks.groupBy("family", "z", "x").applyInArrow(run, "a long, b long")


def _pair(x, y):
    return F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _rooted(texts: DataFrame, threshold: float, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, k1, k2, root: the class of every row of texts (doc_id, k1, k2, text)."""
    scratch = Scratch(texts.sparkSession, "near")
    sigs = scratch.keep(signed(texts, words, bands, rows).withColumn("uid", F.monotonically_increasing_id()))
    full = sigs.where(F.col("bands").isNotNull())
    # nodes: one per distinct weighted set, named by its least uid
    kinds = scratch.keep(full.groupBy("d1", "d2").agg(F.min("uid").alias("node")))
    nodes = full.join(kinds.select("node"), F.col("uid") == F.col("node")).select("node", "k1", "k2", "bands")
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).where("n > 1").select("bucket", "pivot")
    buckets = scratch.keep(members.join(shared, "bucket").select("bucket", "node", "pivot"))
    wanted = buckets.select("node").distinct()
    origin = full.join(wanted, F.col("uid") == F.col("node")).select("node", "k1", "k2")
    sets = scratch.keep(_sets(origin, texts.select("k1", "k2", "text"), words).dropDuplicates(["node"]))

    # every member with its bucket's pivot
    todo = buckets.where("node <> pivot").select(_pair(F.col("pivot"), F.col("node")).alias("p")).select("p.*").distinct()
    links = scratch.keep(_verified(todo, sets).where(F.col("sim") >= threshold).select("a", "b"))
    roots = components(links, scratch)
    more = _family_links(buckets, roots, sets, threshold, scratch)
    if more is not None:
        roots = components(links.unionByName(more), scratch)

    nodes_of = sigs.join(kinds, ["d1", "d2"], "left").withColumn("node", F.coalesce(F.when(F.col("bands").isNotNull(), F.col("node")), F.col("uid")))
    return nodes_of.select("doc_id", "k1", "k2", "node").join(roots, "node", "left").select("doc_id", "k1", "k2", F.coalesce("root", "node").alias("root"))


def keyed(docs: DataFrame) -> DataFrame:
    """Adds k1, k2: 128 bits of a row's doc_id and text."""
    return docs.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.xxhash64(F.lit(17), "text", "doc_id"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id, class_size: one row per row of docs (doc_id, text); class_id is the class's least doc_id."""
    member = _rooted(keyed(docs.select("doc_id", "text")), threshold, words, bands, rows)
    named = member.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return member.join(named, "root").select("doc_id", "class_id", "class_size")


def representatives(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs with one row of each class: that of the least doc_id. Columns are those of ``docs``."""
    member = _rooted(keyed(docs.select("doc_id", "text")), threshold, words, bands, rows)
    each = member.groupBy("root", "doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("copies"))
    h1, h2, k1, k2, copies = (own_name(n) for n in ("h1", "h2", "k1", "k2", "copies"))
    first = each.groupBy("root").agg(F.min_by(F.struct("k1", "k2", "copies"), F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("z")).select(F.col("z.k1").alias(k1), F.col("z.k2").alias(k2), F.col("z.copies").alias(copies))
    own = docs.withColumn(h1, F.xxhash64("doc_id", "text")).withColumn(h2, F.xxhash64(F.lit(17), "text", "doc_id"))
    kept = own.join(first, (F.col(h1) == F.col(k1)) & (F.col(h2) == F.col(k2)))
    alike = kept.where(F.col(copies) > 1).dropDuplicates([h1, h2])
    return kept.where(F.col(copies) == 1).unionByName(alike).select(*[f"`{c}`" for c in docs.columns])
