"""Document quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters of 8 bytes run over a chunk every 4
bytes; each filter's greatest response in the chunk goes through one hidden layer, the chunks' hidden vectors are averaged,
and a logistic unit gives one probability for the document. Filters are tables of a weight per place and byte value, so a
response is a sum of table rows.

The network is fitted in the driver on a bounded sample of labelled rows (``sample_rows`` documents, ``sample_chunks`` chunks
of each, from anywhere in the text, chosen by a generator seeded with its length), so fitting costs the same at any corpus size; scoring reads all bytes.

Defined cases: a null text is empty, and an empty text is scored as a chunk of zero bytes; labels without a document, null
labels and null ids are not learned from; a null doc_id is not held out; without any label, or labels of one kind, the score
is the share of label 1 (one half without labels); very long texts are scored whole; repeated rows get equal scores; an empty
table gives no rows; extra columns are passed on, but one of the score's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, slices, small_batches, text_buffer, trim

WIDTH, STRIDE, FILTERS, HIDDEN = 8, 4, 24, 16
#: Bytes of half a chunk; chunks overlap by one half.
HALF = 256
SAMPLE_ROWS, SAMPLE_CHUNKS = 4096, 8
STEPS, BATCH, RATE = 1500, 64, 0.01
THRESHOLD = 0.7


class Network:
    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.p = {
            "table": r.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32),
            "w2": r.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)).astype(np.float32),
            "b2": np.full(HIDDEN, 0.1, np.float32),
            "w3": r.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32),
            "b3": np.zeros(1, np.float32),
        }

    def fit(self, chunks: np.ndarray, doc: np.ndarray, label: np.ndarray, steps: int = STEPS, seed: int = 2) -> None:
        """Adam on the log loss. chunks: n x (2 * HALF + STRIDE) bytes; doc: the document of each; label per document."""
        r = np.random.default_rng(seed)
        first = np.searchsorted(doc, np.arange(len(label) + 1))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        starts = np.arange(0, 2 * HALF, STRIDE)
        p = self.p
        for step in range(1, steps + 1):
            docs = r.integers(0, len(label), BATCH)
            which = np.concatenate([first[d] + r.permutation(first[d + 1] - first[d])[:4] for d in docs])
            owner = np.repeat(np.arange(BATCH), np.minimum(4, first[docs + 1] - first[docs]))
            x = chunks[which]
            z = sum(p["table"][o][x[:, starts + o]] for o in range(WIDTH))
            best = z.argmax(1)
            h = np.take_along_axis(z, best[:, None, :], 1)[:, 0]
            a = h @ p["w2"] + p["b2"]
            g = np.maximum(a, 0)
            size = np.bincount(owner, minlength=BATCH).astype(np.float32)
            mean = np.zeros((BATCH, HIDDEN), np.float32)
            np.add.at(mean, owner, g)
            mean /= size[:, None]
            out = 1 / (1 + np.exp(-(mean @ p["w3"] + p["b3"][0])))
            d = ((out - label[docs]) / BATCH).astype(np.float32)
            grad = {"w3": mean.T @ d, "b3": np.array([d.sum()], np.float32)}
            dg = (d[:, None] * p["w3"] / size[:, None])[owner] * (a > 0)
            grad["w2"], grad["b2"] = h.T @ dg, dg.sum(0)
            dh = dg @ p["w2"].T
            at = best * STRIDE
            table = np.zeros_like(p["table"])
            cols = np.broadcast_to(np.arange(FILTERS), at.shape)
            for o in range(WIDTH):
                np.add.at(table[o], (x[np.arange(len(x))[:, None], at + o], cols), dh)
            grad["table"] = table
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for k in p:
                gk = grad[k] + 1e-5 * p[k]
                m[k] += 0.1 * (gk - m[k])
                v[k] += 0.01 * (gk * gk - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A probability per text, from every byte of it."""
        p = self.p
        lengths = np.diff(offsets)
        halves = np.maximum(2, -(-lengths // HALF))
        base = np.concatenate([[0], np.cumsum(halves)])
        buffer = np.zeros(int(base[-1]) * HALF + WIDTH, np.uint8)
        rows = np.repeat(base[:-1] * HALF - offsets[:-1], lengths) + np.arange(len(data))
        buffer[rows] = data
        top = np.empty((int(base[-1]), FILTERS), np.float32)
        per = HALF // STRIDE
        final = np.zeros(int(base[-1]) + 1, bool)
        final[base[1:]] = True  # before these halves a text ends: its last window is padded, not run into the next text
        for a in range(0, int(base[-1]), 512):  # halves at a time, to stay in cache
            b = min(a + 512, int(base[-1]))
            part = buffer[a * HALF : b * HALF + WIDTH]
            z = np.take(p["table"][0], part[0 : (b - a) * HALF : STRIDE], axis=0)
            for o in range(1, WIDTH):
                byte = part[o : o + (b - a) * HALF : STRIDE]
                if o >= STRIDE:
                    byte = byte.copy()
                    byte[per - 1 :: per][final[a + 1 : b + 1]] = 0
                z += np.take(p["table"][o], byte, axis=0)
            top[a:b] = z.reshape(b - a, per, FILTERS).max(1)
        ends = base[1:] - 1
        chunk = np.maximum(top[:-1], top[1:])
        keep = np.ones(len(chunk), bool)
        keep[ends[:-1]] = False
        hidden = np.maximum(chunk[keep] @ p["w2"] + p["b2"], 0)
        counts = halves - 1
        mean = np.add.reduceat(hidden, np.cumsum(counts) - counts, axis=0) / counts[:, None]
        return 1 / (1 + np.exp(-(mean @ p["w3"] + p["b3"][0]).astype(float)))


def sampled_chunks(docs: DataFrame, labels: DataFrame, sample_rows: int, sample_chunks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunks, document of each, label per document) of a bounded sample of labelled rows (doc_id, label)."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    size = 2 * HALF + STRIDE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            cut = []
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                n = max(2, -(-len(text) // HALF)) - 1
                at = np.sort(np.random.default_rng(len(text)).permutation(n)[:sample_chunks])
                full = np.zeros((n + 1) * HALF + STRIDE, np.uint8)
                full[: len(text)] = text
                cut.append(b"".join(full[k * HALF : k * HALF + size].tobytes() for k in at))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.binary()), batch.column(2)], names=["h", "chunks", "label"])

    joined = docs.join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), "text", F.col("label").cast("int").alias("label"))
    rows = joined.mapInArrow(run, "h long, chunks binary, label int").orderBy("h").limit(sample_rows).collect()
    parts = [np.frombuffer(r.chunks, np.uint8).reshape(-1, size) for r in rows]
    if not parts:
        return np.zeros((0, size), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts]), np.array([r.label for r in rows], np.float32)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chunks: int = SAMPLE_CHUNKS, steps: int = STEPS) -> Network:
    """A network fitted to labels (doc_id, label 0 or 1) of docs (doc_id, text)."""
    chunks, doc, label = sampled_chunks(docs.select("doc_id", "text"), labels.select("doc_id", "label"), sample_rows, sample_chunks)
    net = Network()
    if len(label) and 0 < label.mean() < 1:
        net.fit(chunks, doc, label, steps)
    else:
        share = min(max(float(label.mean()) if len(label) else 0.5, 1e-3), 1 - 1e-3)
        net.p["w3"][:] = 0
        net.p["b3"][:] = np.log(share / (1 - share))
    return net


def score(docs: DataFrame, net: Network, column: str = "score") -> DataFrame:
    """docs with ``column``: each whole text's probability."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != column]
    at = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(net.p)  # a fixed number of weights, 200 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.__new__(Network)
        own.p = shared.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(at))
            out = [own.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets, SLICE_BYTES // 2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([*out, np.zeros(0)]))], names=[*names, column])
        trim()

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in names]).schema)
    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(run, f"{kind}, `{column}` double")


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame) -> Network:
    """The network of labels.quality, fitted on rows that aren't held out."""
    known = labels.select("doc_id", F.col("quality").alias("label")).where(~held_out(F.col("doc_id")))
    return fit(docs, known)
