"""Public tokenizers on Arrow batches: whole texts to flat ids."""

from __future__ import annotations

import base64
import functools
import itertools
import os
import re

import numpy as np
import pyarrow as pa

from .common import text_buffer

#: Atoms that a worker remembers, and their bytes; a full memory starts anew.
MEMORY_ATOMS, MEMORY_BYTES = 1_000_000, 64 << 20
SPACE, LETTER, SIGN = 0, 1, 2
_KIND = np.full(256, SIGN, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A vocabulary file's place: in ``folder``, or where the public package keeps it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of a tokenizer that lowers case and drops white space, by remembering the ids of short atoms.

    Such a tokenizer's pieces never reach across white space, so a text's ids are those of its words in turn. Pieces don't
    reach from Latin letters into ASCII signs either, so words of only these are cut there too; words with an apostrophe, a
    special id's opening or other characters stay whole. Atoms are found and looked up, by their bytes, a slice of texts at a time.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.bytes, self.used = 0, 0
        self.starts, self.counts = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)

    @staticmethod
    def atoms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes with plain words in lower case, atom starts, atom ends, which bytes are in atoms)."""
        n = len(data)
        kind = _KIND[data]
        before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        before[1:], after[:-1] = data[:-1], data[1:]
        begin = np.zeros(n + 1, bool)
        begin[offsets] = True
        begin = begin[:n]
        solid = kind != SPACE
        turn = np.ones(n, bool)
        turn[1:] = kind[1:] != kind[:-1]
        space_before = np.ones(n, bool)
        space_before[1:] = kind[:-1] == SPACE
        word = solid & (space_before | begin)
        sign = lambda b: (b == 0x97) | (b == 0xB7)  # noqa: E731  the two that aren't letters
        latin = ((data == 0xC3) & ~sign(after)) | ((before == 0xC3) & ~sign(data))
        odd = (data == 0x27) | ((data >= 0x80) & ~latin) | ((data == 0x3C) & (after == 0x7C))
        number = np.cumsum(word) - 1
        whole = np.zeros(int(number[-1]) + 2 if n else 1, bool)
        whole[number[odd & solid]] = True
        kept = whole[number] & solid
        low = np.where(kept, data, _LOWER[data])
        start = word | (solid & turn & ~kept)
        end = np.zeros(n, bool)
        if n:
            end[:-1] = solid[:-1] & (start[1:] | ~solid[1:])
            end[-1] = solid[-1]
        return low, np.flatnonzero(start), np.flatnonzero(end) + 1, solid

    def _learn(self, atoms: list[bytes]) -> None:
        counts, flat = [], []
        for i in range(0, len(atoms), 5_000):
            for e in self.tokenizer.encode_batch_fast([a.decode() for a in atoms[i : i + 5_000]], add_special_tokens=False):
                ids = e.ids
                counts.append(len(ids))
                flat.append(ids)
        ids = np.fromiter(itertools.chain.from_iterable(flat), np.uint32, sum(counts))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        counts = np.array(counts, np.int64)
        first, n = len(self.known), len(atoms)
        while first + n > len(self.counts):
            self.starts, self.counts = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.starts, self.counts))
        self.starts[first : first + n], self.counts[first : first + n] = self.used + np.cumsum(counts) - counts, counts
        self.used += len(ids)
        self.bytes += sum(map(len, atoms))
        self.known.update(zip(atoms, range(first, first + n), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets into them) of the texts data[offsets[i]:offsets[i+1]]."""
        low, start, end, solid = self.atoms(data, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        bounds = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=bounds[1:])
        column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(low[solid].tobytes())]).dictionary_encode()
        inverse = column.indices.to_numpy()
        flat, cut = text_buffer(column.dictionary)
        flat, cut = flat.tobytes(), cut.tolist()
        atoms = [flat[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        if len(self.known) > MEMORY_ATOMS or self.bytes > MEMORY_BYTES:
            self.forget()
        new = [a for a in atoms if a not in self.known]
        if new:
            self._learn(new)
        known = self.known
        at = np.fromiter(map(known.__getitem__, atoms), np.int64, len(atoms))
        count = self.counts[at][inverse]
        ahead = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=ahead[1:])
        where = np.repeat(self.starts[at][inverse] - ahead[:-1], count)
        where += np.arange(len(where))
        return self.pool[where], ahead[np.searchsorted(start, offsets)]


@functools.lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@functools.lru_cache(maxsize=4)
def byte_encoder(path: str):
    """A tiktoken encoding of a rank file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Characters that a byte-level tokenizer's pattern takes for white space.
_BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of white space of this length is taken out of the pattern's way.
LONG_RUN = 1000
_RUN = re.compile(f"[{_BLANK}]{{{LONG_RUN},}}")


def whole_ids(encoding, text: str) -> list[int]:
    """Ids of a whole text by a tiktoken encoding with the public pattern, whatever runs of white space it holds.

    In front of other characters the pattern makes a run without its last character one piece, at a text's end the whole run;
    what follows is cut as if the text began at the run's last character. So a long run is encoded as that piece, which the
    pattern itself can't match beyond about a million characters.
    """
    at, out = 0, []
    for run in _RUN.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        out += encoding.encode_ordinary(text[at : run.start()])
        out += encoding._core_bpe.encode_single_piece(text[run.start() : stop].encode())
        at = stop
    return out + encoding.encode_ordinary(text[at:]) if out else encoding.encode_ordinary(text[at:])
