"""Mixing, packing and token counts."""

import re
import zlib

import numpy as np
import pytest

from gridloom.llm import hashing, license_scan, mixing, near_dedup, packing, separators, tokens
from gridloom.llm.common import text_buffer


def brute_targets(sizes, max_epochs=3.0):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: 1.0 + k % 3 for k, s in enumerate(names)}
    total, held = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in held]
        level = (total - sum(max_epochs * sizes[s] for s in held)) / sum(weight[s] for s in free) if free else 0
        new = {s for s in free if level * weight[s] > max_epochs * sizes[s]}
        if not new:
            return {s: max_epochs * sizes[s] if s in held else level * weight[s] for s in names}
        held |= new


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix(docs_of, mixed_docs, prose):
    rows = mixed_docs + [(60 + i, prose(3, i), "tiny") for i in range(4)] + [(70, "", "zero")]
    got = mixing.mix(docs_of(rows)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    targets = brute_targets(sizes)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r["size"] == count(r.text) and r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source]) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 1
    again = mixing.mix(docs_of(rows).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.text or "", r.taken) for r in again) == sorted((str(r.doc_id), r.text or "", r.taken) for r in got)


def test_mix_runs_no_python(docs_of, mixed_docs):
    plan = mixing.mix(docs_of(mixed_docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_mix_buckets_keep_the_order(docs_of, prose, monkeypatch):
    rows = [(i, prose(10 + i % 5, i), f"s{i % 2}") for i in range(60)]
    whole = sorted((r.doc_id, r.taken) for r in mixing.mix(docs_of(rows)).collect())
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 5)
    split = mixing.mix(docs_of(rows)).collect()
    for s in ("s0", "s1"):
        assert abs(sum(r.taken for r in split if r.source == s) - sum(t for i, t in whole if f"s{i % 2}" == s)) <= 1


def test_repeated_documents(docs_of, mixed_docs):
    docs = docs_of(mixed_docs)
    out = mixing.repeat_documents(docs)
    assert out.columns == docs.columns
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[(r.doc_id, r.source)] = taken.get((r.doc_id, r.source), 0) + r.taken
    words = {}
    for r in out.collect():
        assert r.n_chars == len(r.text) and r.k1 == 7 and r.taken == 1
        words[(r.doc_id, r.source)] = words.get((r.doc_id, r.source), 0) + count(r.text)
    assert words == {k: v for k, v in taken.items() if v}


def test_empty_mix(docs_of):
    assert mixing.mix(docs_of([])).count() == 0 and mixing.repeat_documents(docs_of([])).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))


def check_packing(rows, got, tokenizer, capacity):
    places = {}
    by_doc = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= capacity
    for i, t, _ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        same = [r for r in by_doc[i] if r.start < len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32]
        assert {r.start for r in same} == set(range(0, len(ids), capacity)) and all(r.piece == r.start // capacity for r in same)
    return len(places)


def test_packing(docs_of, mixed_docs, tokenizer):
    got = packing.pack_documents(docs_of(mixed_docs)).collect()
    n = check_packing(mixed_docs, got, tokenizer, 4096)
    assert n <= -(-sum(r.length for r in got) // 4096) + 1
    small = packing.pack_documents(docs_of(mixed_docs), capacity=64).collect()
    check_packing(mixed_docs, small, tokenizer, 64)
    assert packing.pack_documents(docs_of([])).count() == 0


def test_plan_covers_the_histogram():
    for seed in range(6):
        r = np.random.default_rng(seed)
        hist = np.zeros(257, np.int64)
        for v in np.minimum(256, 1 + r.gamma(1.2, 40, 3000).astype(int)):
            hist[v] += 1
        used = np.zeros(257, np.int64)
        packed = packing.plan(hist, 256)
        for lengths, n in packed:
            assert sum(lengths) <= 256 and n > 0
            for v in lengths:
                used[v] += n
        assert (used == hist).all()
        assert sum(n for _, n in packed) <= 1.01 * (hist * np.arange(257)).sum() / 256 + 1
        assert sum(n for lengths, n in packed if 1 < len(lengths) <= 3 and sum(lengths) == 256) > 0


def test_nnls_is_near_the_optimum():
    columns = np.array([[1, 3, 0], [2, 2, 0], [1, 1, 2], [3, 0, 0]])
    target = np.array([0, 10.0, 8, 5])
    x = packing.nnls(columns, target)
    a = np.zeros((4, 4))
    for j, c in enumerate(columns):
        for v in c[c > 0]:
            a[v, j] += 1
    best = np.abs(a[1:] @ np.linalg.lstsq(a[1:], target[1:], rcond=None)[0] - target[1:]).max()
    assert (x >= 0).all() and np.abs(a[1:] @ x - target[1:]).max() <= best + 0.05


def test_encoder_equals_the_tokenizer(tokenizer, monkeypatch):
    import random

    import pyarrow as pa

    r = random.Random(3)
    letters = "aAéÉ'sStT .,!<|>endoftext́  ΣİßK1½”‍×\n\t#"
    texts = ["<|endoftext|> a <|startoftext|>b", "don't Don'T it's”! foo”!x é*** \x1c x\x1dy ﬁ İstanbul ΣΑΣ ß 12ab3", "<|ENDOFTEXT|> end<|endoftext|>mid", "", " \n"]
    texts += ["".join(r.choice(letters) for _ in range(50)) for _ in range(3000)]
    encoder = tokens.WordEncoder(tokens.tokenizer_path("word_bpe_49k.json"))
    monkeypatch.setattr(tokens, "MEMORY_ATOMS", 2000)
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        ids, bounds = encoder.encode(*text_buffer(pa.array(part)))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in part]


def test_words_with_equal_polynomial_hashes_keep_their_ids(tokenizer, docs_of, prose):
    import pyarrow as pa

    a, b = "ab", "ba"
    while len(a) < 2048:  # these agree modulo 2^64 in every polynomial hash
        a, b = a + b, b + a
    encoder = tokens.WordEncoder(tokens.tokenizer_path("word_bpe_49k.json"))
    for part in ([a, b], [b + " x", a]):
        ids, bounds = encoder.encode(*text_buffer(pa.array(part)))
        assert [ids[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:], strict=True)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in part]
    raw = np.frombuffer((a + b).encode(), np.uint8)
    for n in (1, 7, 8, 9, 63, 64, 65, 2048):
        x, y = hashing.word_hashes(raw, np.array([0, 2048]), np.array([n, 2048 + n]))
        assert x != y
    rows = [(1, " ".join([a] * 4 + ["end"]), "s"), (2, " ".join([b] * 4 + ["end"]), "s")]
    assert len({r.class_id for r in near_dedup.classes(docs_of(rows)).collect()}) == 2
    assert not license_scan.scan(docs_of(rows[:1]), {"x": rows[1][1]}).collect()


def test_word_hashes_depend_on_the_word_alone():
    r = np.random.default_rng(2)
    words = [bytes(r.integers(97, 99, n).astype(np.uint8)) for n in r.integers(1, 90, 3000)]
    raw = np.frombuffer(b" ".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    start = np.cumsum(size + 1) - size - 1
    h = hashing.word_hashes(raw, start, start + size)
    assert len(set(h.tolist())) == len(set(words)) == len({(w, int(x)) for w, x in zip(words, h, strict=True)})


@pytest.mark.parametrize("unit", [" ", "\n", "\u00a0 ", " \t\r\n\u3000", "a", "-", "1", "\x1c"])
def test_ids_of_long_runs(unit):
    encoder = tokens.byte_encoder(tokens.tokenizer_path("byte_bpe_50k.tiktoken"))
    run = unit * 3000
    for text in (run, "word" + run, run + "word", "a." + run + "\nb" + run + " c " + run, run + "'s", "x" + run + " é" + run + "1"):
        assert tokens.whole_ids(encoder, text) == encoder.encode_ordinary(text)
    vast = unit * (10_000_000 // len(unit)) + "b"  # the tokenizer itself can't take the white ones
    ids = tokens.whole_ids(encoder, vast)
    assert encoder.decode_bytes(ids) == vast.encode()


def test_token_counts_of_vast_runs(docs_of, mixed_docs):
    rows = [(1, " " * 2_000_000 + "x", "s"), (2, "\n" * 1_500_000, "s"), (2, None, "s"), (None, "a" * 100_000, None)]
    got = sorted((str(r.doc_id), r.n_tokens) for r in separators.count_documents(docs_of(rows)).collect())
    encoder = tokens.byte_encoder(tokens.tokenizer_path("byte_bpe_50k.tiktoken"))
    assert got == sorted((str(i), len(tokens.whole_ids(encoder, t or ""))) for i, t, _ in rows)


def test_token_counts(docs_of, mixed_docs):
    encoder = tokens.byte_encoder(tokens.tokenizer_path("byte_bpe_50k.tiktoken"))
    got = separators.count_documents(docs_of(mixed_docs)).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(encoder.encode_ordinary(t or ""))) for i, t, _ in mixed_docs)
    assert separators.count_documents(docs_of([])).count() == 0


@pytest.mark.parametrize("size", [2, 6, 14, 64])
def test_scan_of_any_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(separators, "SPAN", 3)
    r = np.random.default_rng(1)
    rows, expected = [], []
    for file in range(5):
        ids = r.integers(0, 4, 90).astype("<u2") if file else np.zeros(0, "<u2")
        if file == 2:
            ids[:] = 1  # no separator at all
        if file == 3:
            ids[:] = 0  # nothing but separators
        raw = ids.tobytes()
        rows += [(file, k, bytearray(raw[a : a + size])) for k, a in enumerate(range(0, len(raw), size))]
        ends = np.flatnonzero(ids == 0)
        lengths = np.diff(ends, prepend=-1) - 1
        expected += [(file, k, int(n), True) for k, n in enumerate(lengths)]
        rest = len(ids) - (ends[-1] + 1 if len(ends) else 0)
        expected += [(file, len(lengths), int(rest), False)] if rest else []
    blocks = spark.createDataFrame(rows, "file long, block long, data binary").repartition(4)
    assert sorted(map(tuple, separators.document_lengths(blocks, 0).collect())) == expected
