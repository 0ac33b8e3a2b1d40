"""Near copies and repeated strings against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import common, components, near_dedup, suffix_dedup
from gridloom.llm.common import Scratch


def weighted(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def probability_jaccard(x, y):
    both = x.keys() & y.keys()
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys()) for i in both)


def brute_classes(rows):
    sets = [weighted(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i]) < 3000 and probability_jaccard(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return sorted((rows[i][0] if rows[i][0] is not None else -1, min((rows[k][0] for k in g if rows[k][0] is not None), default=-1), len(g)) for g in groups.values() for i in g)


def test_near_classes(docs_of, mixed_docs):
    got = near_dedup.classes(docs_of(mixed_docs)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.class_id if r.class_id is not None else -1, r.class_size) for r in got) == brute_classes(mixed_docs)


def test_chains_of_near_copies_are_one_class(docs_of, prose):
    # each text is near to the next only: buckets keep members of different components, which blocks must link
    words = prose(120, 3).split()
    rows = []
    for k in range(40):
        words = list(words)
        words[(k * 29) % 120] = f"new{k}"
        rows.append((k, " ".join(words), "s"))
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in near_dedup.classes(docs_of(rows)).collect()) == brute_classes(rows)


def test_small_blocks_give_the_same_classes(docs_of, prose, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 2000)
    test_chains_of_near_copies_are_one_class(docs_of, prose)


def test_representatives(docs_of, mixed_docs):
    docs = docs_of(mixed_docs)
    kept = near_dedup.representatives(docs)
    assert kept.columns == docs.columns
    classes = near_dedup.classes(docs).collect()
    assert kept.count() == len({r.class_id for r in classes if r.class_id is not None}) + sum(r.class_id is None for r in classes)
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {r.class_id for r in classes if r.class_id is not None}


def test_signatures_estimate_the_similarity():
    r = np.random.default_rng(0)
    diffs = []
    for n, share in ((40, 30), (500, 400), (3, 2)):
        for _ in range(40):
            e, w = r.integers(0, 2**44, 2 * n - share, dtype=np.uint64), r.integers(1, 5, 2 * n - share)
            order_a, order_b = np.argsort(e[:n]), np.argsort(e[n - share :])
            a, wa, b, wb = e[:n][order_a], w[:n][order_a], e[n - share :][order_b], w[n - share :][order_b]
            s = near_dedup.signatures(np.repeat([0, 1], n), np.concatenate([a, b]), np.concatenate([wa, wb]), 2, 144)
            diffs.append((s[0] == s[1]).mean() - near_dedup.similarity(a, wa, b, wb))
    assert abs(np.mean(diffs)) < 0.012 and np.std(diffs) < 0.06


def test_similarity_formula():
    x, y = Counter("aabbbc"), Counter("aabbd")
    arrays = lambda c: (np.array(sorted(ord(k) for k in c), np.uint64), np.array([c[chr(k)] for k in sorted(ord(k) for k in c)]))
    assert near_dedup.similarity(*arrays(x), *arrays(y)) == pytest.approx(probability_jaccard(x, y))


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {k: 100 for k in range(101, 140)} | {201: 200}


def brute_repeats(rows, length):
    texts = [(t or "").encode() for _, t, _ in rows]
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        edge = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                edge[i] += 1
                edge[i + length] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [400, 60])
def test_repeats(docs_of, mixed_docs, length):
    rows = [r for r in mixed_docs if r[0] != 40] + [(50, mixed_docs[3][1][:300] + "Z" + mixed_docs[3][1][300:], "s"), (51, mixed_docs[4][1] * 3, "s")]
    got = suffix_dedup.remove_repeats(docs_of(rows), length).collect()
    key = lambda i: -1 if i is None else i
    assert sorted((key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((key(i), *b) for (i, _, _), b in zip(rows, brute_repeats(rows, length), strict=True))


def test_repeats_of_frequent_passages(docs_of, prose, monkeypatch):
    # contexts of one anchor beyond the limit are cut into ranges; the result stays
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    monkeypatch.setattr(suffix_dedup, "STEP", 2000)
    monkeypatch.setattr(suffix_dedup, "BATCH", 7)
    passage = prose(50, 77)
    rows = [(i, prose(60, 200 + i) + " " + passage[i % 4 : len(passage) - i % 3] + " " + prose(60, 300 + i), "s") for i in range(40)] + [(100, prose(3000, 5), "s"), (101, prose(3000, 5)[4000:9000], "s")]
    got = sorted((r.doc_id, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs_of(rows), 120).collect())
    assert got == sorted((i, b[1], b[2]) for (i, _, _), b in zip(rows, brute_repeats(rows, 120), strict=True))


def test_remaining_text(docs_of, prose):
    passage = "é" * 60 + prose(20, 77) + "中\U0001f600" * 20
    raw = passage.encode()
    inner = raw[1:-1]  # a repeat that begins and ends inside characters
    rows = [(1, "a ü" + passage + "ö z", "s"), (2, "b" + passage + "y", "s"), (3, None, "s"), (4, "", "s"), (5, "alone é", "s"), (6, passage[1:-1], "s")]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs_of(rows), 100).collect()}
    assert got[1].text == "a üö z" and got[2].text == "by" and got[3].text == got[4].text == got[6].text == "" and got[5].text == "alone é" and len(inner) == len(raw) - 2
    # U+00E9 and U+00E8 share their first byte: what is covered starts at their second
    split = [(1, "xé" + "q" * 200, "s"), (2, "yè" + "q" * 200, "s"), (3, "é" + "r" * 200 + "\u00ff", "s"), (4, "z" + "r" * 200 + "\u00fe", "s")]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs_of(split), 100).collect()}
    assert got[1].text == "xé" and got[2].text == "yè" and got[3].text == "é" and got[4].text == "z"
    assert got[3].n_removed == 201  # the first byte of the last character is covered too, so the character goes
    assert all(r.n_bytes - r.n_removed >= len(r.text.encode()) for r in got.values())


def test_strip(docs_of, mixed_docs):
    docs = docs_of(mixed_docs)
    got = {r.doc_id: r for r in suffix_dedup.strip_repeats(docs, 400).collect()}
    assert suffix_dedup.strip_repeats(docs, 400).columns == docs.columns
    assert 20 not in got and 21 not in got and 41 in got and got[30].text == "" and got[31].text is None and got[5].text == mixed_docs[5][1]
    assert got[23].n_chars == len(got[23].text) < len(mixed_docs[15][1])


def test_family_merges_geometrically():
    f = suffix_dedup.Family(8, 4)
    for k in range(64):
        f.add([b"%04dxxxx" % (4 * k + i) for i in range(4)], [b"abcd"] * 4)
    assert len(f.levels) <= 8 and sum(len(x[0]) for x in f.levels) == 256 and (f.high == -1).all()
    for by_right, by_left in f.levels:
        assert [f.right[i] for i in by_right] == sorted(f.right[i] for i in by_right) and sorted(by_right) == sorted(by_left)
    f.add([b"0009xx"], [b"abZ"])
    assert f.high[9] == f.high[256] == f.low[9] == 2 and (np.delete(f.high, [9, 256]) == -1).all()


def brute_family(entries, length, side):
    out = []
    for i, (right, left) in enumerate(entries):
        found = [
            k
            for k in range(max(0, length - len(right)), min(side, len(left)) + 1)
            if any(j != i and x[: length - k] == right[: length - k] and y[:k] == left[:k] and len(x) >= length - k and len(y) >= k for j, (x, y) in enumerate(entries))
        ]
        out.append((min(found), max(found)) if found else None)
    return out


@pytest.mark.parametrize("per_batch", [1, 3, 100])
def test_family_finds_what_brute_force_finds(per_batch):
    r = np.random.default_rng(per_batch)
    for length, core in ((12, 3), (20, 5), (8, 4)) * 8:
        side, entries = length - core, []
        base = r.choice(list(b"ab\0"), length + side).astype(np.uint8)
        for _ in range(r.integers(2, 40)):
            b = base.copy()
            b[r.integers(0, len(b), r.integers(0, 4))] = r.choice(list(b"ab\0"))
            s, e = r.choice([0, 0, r.integers(0, side)]), r.choice([len(b), len(b), r.integers(side + core, len(b))])
            entries.append((b[side:e].tobytes(), b[s:side].tobytes()[::-1]))
        f = suffix_dedup.Family(length, side)
        for at in range(0, len(entries), per_batch):
            f.add(*(list(x) for x in zip(*entries[at : at + per_batch], strict=True)))
        assert [(int(a), int(z)) if z >= 0 else None for a, z in zip(f.low, f.high, strict=True)] == brute_family(entries, length, side)


def thue_morse(bits):
    """Two strings of equal length whose polynomial hashes modulo 2^64 agree for every multiplier."""
    a, b = "ab", "ba"
    while len(a) < bits:
        a, b = a + b, b + a
    return a, b


def test_strings_with_equal_fingerprints_stay(docs_of, prose):
    a, b = thue_morse(2048)
    rows = [(1, prose(100, 1) + a, "s"), (2, prose(100, 2) + b, "s"), (3, prose(100, 3) + b[100:900], "s")]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs_of(rows), 400).collect())
    assert got == sorted((i, *x) for (i, _, _), x in zip(rows, brute_repeats(rows, 400), strict=True))


def test_equal_passages_in_many_contexts(docs_of, prose, monkeypatch):
    # one passage longer than a string in contexts that all differ: halves become equal entries, and joins set its keys apart
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    monkeypatch.setattr(common, "FREQUENT_ROWS", 3)
    passage, line = prose(40, 8), prose(12, 9)
    rows = [(i, prose(15, 500 + i) + passage + prose(15, 600 + i) + line + prose(15, 700 + i), "s") for i in range(60)] + [(90 + i, passage, None) for i in range(20)]
    got = sorted((r.doc_id, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs_of(rows), 100).collect())
    assert got == sorted((i, b[1], b[2]) for (i, _, _), b in zip(rows, brute_repeats(rows, 100), strict=True))


def test_empty_tables(docs_of):
    none = docs_of([])
    assert near_dedup.classes(none).count() == near_dedup.representatives(none).count() == suffix_dedup.remove_repeats(none).count() == suffix_dedup.strip_repeats(none).count() == 0
