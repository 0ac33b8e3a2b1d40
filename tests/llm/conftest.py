import random

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A function that makes documents of (doc_id, text, source) rows, with columns whose names the operators use too."""

    def make(rows):
        full = [(i, t, "en", s, len(t) if t is not None else None, 7, "x", 1, "y", 2.0) for i, t, s in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, k1 int, node string, taken int, h string, score double")

    return make


@pytest.fixture(scope="session")
def prose():
    """A function that gives n words of invented prose, seeded."""
    r = random.Random(5)
    words = ["".join(r.choice(["ta", "lo", "mi", "ren", "sü", "ka", "der"]) for _ in range(r.randint(1, 4))) for _ in range(4000)]

    def make(n, seed):
        q = random.Random(seed)
        return " ".join(q.choice(words) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def mixed_docs(prose):
    """(doc_id, text, source): plain, copied, edited, shared passages, empty, null, blank, long, tiny, repeated rows."""
    rows = [(i, prose(40 + 7 * i, i), f"s{i % 3}") for i in range(12)]
    base = prose(300, 99)
    edited = base.split()
    edited[150] = "changed"
    rows += [(20, base, "s0"), (21, base, "s0"), (22, " ".join(edited), None), (23, prose(30, 1) + " " + base[200:900] + " " + prose(30, 2), "s1")]
    rows += [(30, "", "s0"), (31, None, "s1"), (32, "   \n", None), (33, "one two", "s2"), (34, "one two", "s2"), (35, "é" * 1000, "s0"), (36, "ab" * 700, "s1")]
    rows += [(40, prose(60000, 7), "s0"), (41, rows[0][1], "s0"), (41, rows[0][1], "s0"), (None, prose(20, 8), "s2"), (None, None, None)]
    return rows
