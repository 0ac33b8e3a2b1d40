"""Vector codes, spelling variants and byte-level encoding."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import bpe, codes, errata
from gridloom.llm.common import Scratch
from gridloom.llm.tokens import byte_encoder, tokenizer_path, whole_ids

# -- codes --


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """(id, code, error) and the digest, by full distance tables."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = -(-max(len(v) for _, v in kept) // parts)
    m = np.array([v + [0] * (parts * size - len(v)) for _, v in kept], np.int64).reshape(len(kept), parts, size)
    books = m[:entries].copy()
    for r in range(rounds + 1):
        gaps = ((m[:, None] - books[None]) ** 2).sum(3)
        pick = gaps.argmin(1)
        if r < rounds:
            for p in range(parts):
                for e in range(len(books)):
                    mine = m[pick[:, p] == e, p]
                    if len(mine):
                        books[e, p] = mine.sum(0) // len(mine)
    text = ",".join(str(x) for p in range(parts) for e in range(len(books)) for x in books[e, p].tolist())
    return [(i, "".join(f"{x:02x}" for x in c), int(g.min(0).sum())) for (i, _), c, g in zip(kept, pick, gaps, strict=True)], hashlib.sha256(text.encode()).hexdigest()


def test_trees_find_the_lowest_of_equals():
    r = np.random.default_rng(0)
    for k in (1, 2, 3, 5, 17, 64, 80):
        entries, x = r.integers(-2, 3, (k, 3)), r.integers(-3, 4, (300, 3))
        entry, gap, _ = codes.Tree(entries).nearest(x)
        table = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (entry == table.argmin(1)).all() and (gap == table.min(1)).all()
    spread, x = r.integers(-1000, 1000, (256, 4)), r.integers(-1000, 1000, (500, 4))
    assert codes.Tree(spread).nearest(x)[2] < 500 * 256 / codes.LEAF / 4  # most leaves are never read


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(1)).withColumn("v", F.lit("x")).withColumn("code", F.lit("y")).withColumn("o0", F.lit(2))


def test_codes(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(0, 0.1, 64).astype(np.float32).tolist(), None if i % 7 == 0 else i % 3) for i in range(150)]
    rows += [(5, rows[5][1], 2), (5, rows[5][1], 2), (None, rows[9][1], 1), (900, None, 1), (901, [], 1), (902, [float("nan")] * 64, 1), (903, [float("inf")] + [0.0] * 63, 1), (904, [None] + [0.0] * 63, None), (905, [0.0] * 64, 0), (906, [0.5] * 10, 0)]
    got = codes.compress(vectors(spark, rows).repartition(5), "vec_id", "embedding", "label").collect()
    want, digest = brute_codes([(i, v) for i, v, _ in rows])
    assert sorted((str(g.id), g.code, g.error) for g in got) == sorted((str(i), c, e) for i, c, e in want)
    assert {g.codebooks_sha256 for g in got} == {digest}
    label, error = {}, {(i, e) for i, _, e in want}
    for i, v, k in rows:
        if v and all(x is not None and np.isfinite(x) for x in v):
            label[k] = label.get(k, 0) + next(e for j, e in error if j == i)
    assert {g.label_error for g in got} == set(label.values())


def test_few_vectors_and_none(spark):
    rows = [(i, [0.1 * i] * 16, i) for i in range(3)]
    got = codes.compress(vectors(spark, rows), "vec_id", "embedding", "label").collect()
    want, digest = brute_codes([(i, v) for i, v, _ in rows])
    assert sorted((g.id, g.code, g.error) for g in got) == sorted(want) and got[0].codebooks_sha256 == digest
    assert codes.compress(vectors(spark, rows).limit(0), "vec_id", "embedding", "label").count() == 0


def test_codes_stand_for_vectors(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(0, 0.1, 32).tolist(), 0) for i in range(100)]
    ints, size = codes.integers(vectors(spark, rows), "vec_id", "embedding")
    books = codes.learned(ints, size)
    full = {x.id: x.v for x in ints.collect()}
    for c in codes.encode(ints, books).collect():
        back = codes.decoded(np.frombuffer(bytes.fromhex(c.code), np.uint8)[None].astype(int), books)[0]
        assert ((back - np.array(full[c.id])) ** 2).sum() == c.error


# -- words --


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = (u, v) if len(u) > len(v) else (v, u)
    return len(u) == len(v) + 1 and any(u[:i] + u[i + 1 :] == v for i in range(len(u)))


def test_errata_tries():
    r = random.Random(1)
    for _ in range(150):
        letters = "abcdé"[: r.choice([1, 2, 3, 5])]
        words = sorted({"".join(r.choice(letters) for _ in range(r.randint(0, 7))) for _ in range(r.randint(0, 90))})
        got = sorted(tuple(sorted(p)) for p in errata.near_in_task(words))
        assert got == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i], words[j])]


def test_long_words_share_their_nodes():
    a = "ab" * 300_000
    words = sorted([a, a + "c", a[:-1], a[:1000] + "x" + a[1001:], a[:50] + a[51:], "z" + a])
    assert len(errata.trie(words)) < 12
    want = [(i, j) for i in range(6) for j in range(i + 1, 6) if (words[i] == a) or (words[j] == a)]
    assert sorted(tuple(sorted(p)) for p in errata.near_in_task(words)) == want


@pytest.mark.parametrize("group_words", [3, 40])
def test_subtrees_too_large_for_a_task(spark, group_words):
    r = random.Random(4)
    words = sorted({"".join(r.choice("abé") for _ in range(r.randint(0, 6))) for _ in range(250)} | {"aaaa" + "".join(r.choice("ab") for _ in range(4)) for _ in range(30)})
    df = spark.createDataFrame([(w, len(w) + 1) for w in words], "word string, n long")
    got = sorted(tuple(sorted((p.a, p.b))) for p in errata.near_pairs(df, Scratch(spark, "test"), group_words).collect())
    assert got == sorted((u, v) for i, u in enumerate(words) for v in words[i + 1 :] if near(u, v))
    assert all(p.a_n == len(p.a) + 1 and p.b_n == len(p.b) + 1 for p in errata.near_pairs(df, Scratch(spark, "test"), group_words).limit(50).collect())


def brute_variants(rows):
    import re

    count = {}
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] = count.get(w, 0) + 1
    n = {w: k for w, k in count.items() if k >= 3 and len(w) >= 5}
    form, out = {}, []
    for w in n:
        close = [v for v in n if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out.append((w, len(close)))
    rows = []
    for w, k in out:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], k, n[form[w]] if form[w] else None))
    return rows


def test_variants(spark, docs_of, prose, mixed_docs):
    r = random.Random(9)
    base = [prose(1, k).split()[0].ljust(5, "e") for k in range(40)]
    rows = [(i, t) for i, t, _ in mixed_docs]
    for i in range(100, 200):
        words = []
        for _ in range(120):
            w = base[int(r.random() ** 3 * 40)]
            for _ in range(int(r.random() ** 4 * 3)):  # several edits make chains of forms
                k = r.randrange(len(w))
                w = w[:k] + r.choice(["", "x", "É", "ÿ" + w[k]]) + w[k + 1 :]
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, " - ".join(words) + "×÷1é"))
    rows += [(500, "long" * 50_000 + " " + "LONG" * 50_000), (501, "long" * 50_000 + "x"), (502, "long" * 50_000)]
    got = errata.variants(docs_of([(i, t, "s") for i, t in rows])).collect()
    want = brute_variants(rows)
    assert sorted(map(tuple, got), key=lambda x: x[0]) == sorted(want, key=lambda x: x[0])
    assert any(w[1] and w[2] != w[1] for w in want)  # some form has a form
    assert errata.variants(docs_of([])).count() == 0 and errata.variants(docs_of([(1, None, "s"), (2, "", "s"), (3, "a b", None)])).count() == 0


# -- bytes --


@pytest.fixture(scope="module")
def multi():
    return bpe.encoder(tokenizer_path(bpe.VOCABULARY)), byte_encoder(tokenizer_path(bpe.VOCABULARY))


def test_pieces_equal_merging(multi):
    ours, theirs = multi
    r, names = random.Random(2), sorted(ours.bpe.ranks)
    for k in range(3000):
        some = (b"abcet  in", bytes(range(256)), "éüßтаин中的".encode())[k % 3]
        piece = bytes(r.choice(some) for _ in range(r.randint(1, 30))) if k % 4 else b"".join(r.choice(names) for _ in range(r.randint(1, 6)))
        assert ours.bpe.encode_piece(piece) == theirs._core_bpe.encode_single_piece(piece)
    for piece in (b"a" * 50_000, b"ab" * 20_000, b"abcabd" * 10_000):
        assert ours.bpe.encode_piece(piece) == theirs._core_bpe.encode_single_piece(piece)


def test_ranks_that_merging_cannot_reach():
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"xyz": 259, b"cd": 260, b"abcd": 261}
    own, theirs = bpe.Bpe(ranks), tiktoken.Encoding("own", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    for _ in range(2000):
        piece = "".join(r.choice("abcdxyz") for _ in range(r.randint(1, 9))).encode()
        assert own.encode_piece(piece) == theirs._core_bpe.encode_single_piece(piece)


def test_round_trip(spark, docs_of, mixed_docs, multi):
    rows = [(i, t, s) for i, t, s in mixed_docs] + [(50, "a" * 300_000, "s"), (51, " " * 5000 + "\n\n x  ", "s"), (52, "don't 123 中文 ​\U0001f600 é <|endoftext|>", "s"), (53, "\x00\x1f ", "s")]
    docs = docs_of(rows)
    want = []
    for i, t, _ in rows:
        ids = whole_ids(multi[1], t or "")
        want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [(str(g.doc_id), g.n_tokens, g.ids_sha256, g.decoded_sha256) for g in bpe.round_trip(docs).collect()]
    assert sorted(got) == sorted(want)
    back = bpe.decode_ids(bpe.encode_documents(docs)).collect()
    assert sorted((str(b.doc_id), bytes(b.bytes)) for b in back) == sorted((str(i), (t or "").encode()) for i, t, _ in rows)
    assert bpe.round_trip(docs_of([])).count() == 0
