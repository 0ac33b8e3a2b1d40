"""Byte-level BPE by backtracking over longest matches, and its inverse.

A piece of text (a match of the tokenizer's pattern) is split as merging by rank would split it, without merging: bytes become
Latin-1 characters, an automaton of all tokens finds the longest token at every place in one pass, and tokens are put one after
another. A sequence of tokens is the merged one exactly if each two neighbours are compatible, that is if no merge crosses
their border; this is remembered for every two tokens asked for. Where no token fits, a place is marked and the last token
shortened; each place is marked once, so a piece takes linear time whatever its length.

Defined cases: a null text is empty and has no ids (the digest is that of no bytes); null ids are kept; long texts and long pieces
are treated whole; repeated rows count each; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, take, text_buffer
from .tokens import tokenizer_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces, and pairs of tokens, that a worker remembers, and the bytes of these pieces; a full memory starts anew.
MEMORY_PIECES, MEMORY_BYTES, MEMORY_PAIRS = 500_000, 32 << 20, 1_000_000
#: Bytes of text whose pieces are looked up at once.
STEP_BYTES = 1 << 18
NEVER = 1 << 62


class Bpe:
    """Encoder and decoder of a vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.spines: dict[int, tuple[list[int], list[int]]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[int, int] = {}
        for rank, parts in self._splits():
            name = self.token[rank].decode("latin-1")
            self.automaton.add_word(name, (rank, len(name) - 1))
            self.spines[rank] = parts
        self.automaton.make_automaton()
        for rank in self.spines:
            name = self.token[rank]
            self.shorter[rank] = next((r for k in range(len(name) - 1, 0, -1) if (r := ranks.get(name[:k])) in self.spines), -1)
        top = max(self.token, default=-1) + 1
        names = [self.token.get(r, b"") for r in range(top)]
        self.flat = np.frombuffer(b"".join(names), np.uint8)
        self.length = np.fromiter(map(len, names), np.int64, top)
        self.start = np.cumsum(self.length) - self.length

    def _splits(self) -> Iterator[tuple[int, tuple[list[int], list[int]]]]:
        """Tokens that merging can make, each with its left and right spine: the tokens at its border, smallest first.

        A token no merge makes of its own bytes can only be a whole piece.
        """
        spines: dict[int, tuple[list[int], list[int]]] = {}
        for rank in sorted(self.token):
            name = self.token[rank]
            if len(name) == 1:
                spines[rank] = [rank], [rank]
            else:
                parts = self._merge(name, rank)
                if len(parts) != 2 or not all(p in spines for p in parts):
                    continue
                left, right = spines[parts[0]][0], spines[parts[1]][1]
                spines[rank] = [*left, rank], [*right, rank]
            yield rank, spines[rank]

    def _merge(self, name: bytes, below: int) -> list[int]:
        """A short string split by merges of ranks under ``below``, the least first, the leftmost of equals first."""
        parts = [name[i : i + 1] for i in range(len(name))]
        while len(parts) > 1:
            r, i = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if r >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _union(self, a: int, b: int) -> int:
        key = (a, b)
        r = self.merged.get(key)
        if r is None:
            if len(self.merged) > MEMORY_PAIRS:
                self.merged.clear()
            r = self.merged[key] = self.ranks.get(self.token[a] + self.token[b], NEVER)
        return r

    def compatible(self, a: int, b: int) -> bool:
        """No merge crosses the border of two tokens, as they grow from their border bytes by rank."""
        key = (a, b)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > MEMORY_PAIRS:
                self.fits.clear()
            known = self.fits[key] = self._compatible(self.spines[a][1], self.spines[b][0])
        return known

    def _compatible(self, left: list[int], right: list[int]) -> bool:
        i = j = 0
        while True:
            cross = self._union(left[i], right[j])
            grow_left = left[i + 1] if i + 1 < len(left) else NEVER
            grow_right = right[j + 1] if j + 1 < len(right) else NEVER
            if cross < grow_left and cross <= grow_right and cross < NEVER:  # of equal ranks the leftmost merges first
                return False
            if grow_left == grow_right == NEVER:
                return True
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, token, fits = len(piece), self.token, self.compatible
        longest = [-1] * n
        for end, (rank, back) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - back] = rank  # of one start, matches come shortest first
        dead, out, at = bytearray(n + 1), [], 0
        now = longest[0]
        while at < n:
            while now >= 0:
                end = at + len(token[now])
                if not dead[end] and (not out or fits(out[-1], now)):
                    break
                now = self.shorter[now]
            if now >= 0:
                out.append(now)
                at = end
                now = longest[at] if at < n else -1
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead[at] = 1
                now = out.pop()
                at -= len(token[now])
                now = self.shorter[now]
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, where each id's bytes end) of ids."""
        size = self.length[ids]
        end = np.cumsum(size)
        return self.flat[np.repeat(self.start[ids] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)], end


class Encoder:
    """Whole texts to ids: pieces by the pattern, ids of known pieces from memory."""

    def __init__(self, bpe: Bpe, pattern: str):
        self.bpe, self.pieces = bpe, regex.compile(pattern).findall
        self.decimals = [b"%d," % r for r in range(len(bpe.length))]
        self.decimal_length = np.fromiter(map(len, self.decimals), np.int64, len(self.decimals))
        self.decimal_start = np.cumsum(self.decimal_length) - self.decimal_length
        self.decimal_flat = np.frombuffer(b"".join(self.decimals), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.bytes, self.used = 0, 0
        self.starts, self.counts = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.pool = np.zeros(1 << 16, np.int64)

    def _learn(self, piece: str) -> int:
        raw, at = piece.encode(), len(self.known)
        ids = self.bpe.encode_piece(raw)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        if at == len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[at], self.counts[at] = self.used, len(ids)
        self.used += len(ids)
        self.bytes += len(raw)
        self.known[piece] = at
        return at

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each text's ids end)."""
        if len(self.known) > MEMORY_PIECES or self.bytes > MEMORY_BYTES:
            self.forget()
        found = [self.pieces(t) for t in texts]
        known, flat = self.known, [p for ps in found for p in ps]
        for p in set(flat).difference(known):
            self._learn(p)
        at = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        count = self.counts[at]
        end = np.zeros(len(at) + 1, np.int64)
        np.cumsum(count, out=end[1:])
        ids = self.pool[np.repeat(self.starts[at] - end[:-1], count) + np.arange(int(end[-1]))]
        return ids, end[np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))]

    def written(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, where each id ends) of the ids in decimal digits, each followed by a comma."""
        size = self.decimal_length[ids]
        end = np.cumsum(size)
        return self.decimal_flat[np.repeat(self.decimal_start[ids] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)], end


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a rank file, with the public pattern."""
    import public_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Encoder(Bpe(ranks), public_tokenizers.PATTERN)


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """doc_id, ids array<int> of every whole text of the documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer_path(vocabulary, folder))
        for batch, a, b, ids, end in _encoded(e, batches):
            offsets = pa.array(np.concatenate([[0], end]), pa.int32())
            yield pa.RecordBatch.from_arrays([take(batch.column(0), np.arange(a, b)), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """doc_id, bytes binary of every list of ids; a null list is empty, and an id that the vocabulary lacks is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_path(vocabulary, folder)).bpe
        for batch in batches:
            lists = batch.column(1)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(bpe.length) or not bpe.length[ids].all()):
                raise ValueError("an id that the vocabulary lacks")
            data, end = bpe.decode(ids)
            cut = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])]
            raw = memoryview(data.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bytes(raw[a:b]) for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, bytes binary")


def _encoded(e: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        column = batch.column(1).fill_null("")
        _, offsets = text_buffer(column)
        for a, b in slices(offsets, STEP_BYTES):
            ids, end = e.encode(take(column, np.arange(a, b)).to_pylist())
            yield batch, a, b, ids, end


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer_path(vocabulary, folder))
        sha = hashlib.sha256
        for batch, a, b, ids, end in _encoded(e, batches):
            cut, digests = np.concatenate([[0], end]), []
            for (data, ends), tail in ((e.written(ids), 1), (e.bpe.decode(ids), 0)):
                edge, raw = np.concatenate([[0], ends])[cut].tolist(), memoryview(data)
                digests.append([sha(raw[u : max(u, v - tail)]).hexdigest() for u, v in zip(edge, edge[1:], strict=False)])
            n = pa.array(np.diff(cut), pa.int64())
            yield pa.RecordBatch.from_arrays([take(batch.column(0), np.arange(a, b)), n, *map(pa.array, digests)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
