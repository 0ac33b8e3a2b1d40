"""Spelling variants: words one edit apart, by errata-trie merging, and the forms that they follow.

Two words are near if they differ by one inserted, deleted or replaced character. The first place where such words part is a
branch of the trie of all words, and there either word's character is skipped, or both are. So every pair comes from one node
of the trie: subtrees below it are merged as if their first character weren't there, and terminals that coincide are pairs.

* Below nodes of at most ``GROUP_WORDS`` words that happens inside a task, along heavy paths: light subtrees are merged with each
  other, from small to large, and walked against the heavy one, so a word is visited once for each light edge above it.
* Above, where a subtree is too large for a task, the same merging is a shuffle: each word is sent to the string that it
  becomes without the node's character. As many words meet there as there are characters, and each meeting is a pair.

Defined cases: null texts have no words; a null id counts as an empty string in the seeded edits; empty texts give nothing; long
texts and long runs are treated whole; repeated rows count each; ties go to the smaller word in code-point order; an empty
table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frequent_join, slices, take, text_buffer

#: Words of a subtree that one task merges.
GROUP_WORDS = 8_000
#: Rows of partial counts that a task holds.
HELD_ROWS = 500_000
LEAST_LENGTH, LEAST_COUNT, EDIT_SHARE, FORM_RATIO = 5, 3, 97, 2

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# -- words --


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and code points of the maximal runs of A-Z, a-z and U+00C0 to U+00FF; none crosses a text's end."""
    n = len(data)
    lead = data == 0xC3  # in UTF-8 the letters beyond ASCII are this byte and one that follows
    letter = _LETTER[data] | lead
    letter[1:] |= lead[:-1]
    begin = np.zeros(n + 1, bool)
    begin[offsets] = True
    start, end = letter.copy(), letter.copy()
    start[1:] &= ~letter[:-1] | begin[1:n]
    end[:-1] &= ~letter[1:] | begin[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    leads = np.zeros(n + 1, np.int64)
    np.cumsum(lead, out=leads[1:])
    return s, e, e - s - (leads[e] - leads[s])


def words_of(data: np.ndarray, offsets: np.ndarray, ids: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Words of the texts, with the seeded deletions, and how often each occurs in each text."""
    start, end, points = runs(data, offsets)
    long = points >= LEAST_LENGTH
    start, end, points = start[long], end[long], points[long]
    if not len(start):
        return [], np.zeros(0, np.int64)
    low, bounds = _LOWER[data], np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=bounds[1:])
    held = np.zeros(len(data) + 1, np.int8)
    held[start] += 1
    held[end] -= 1
    flat = low[np.cumsum(held[:-1], dtype=np.int8).astype(bool)]
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(flat.tobytes())]).dictionary_encode()
    known = column.dictionary.to_pylist()
    pair, count = np.unique((np.searchsorted(offsets, start, "right") - 1) * len(known) + column.indices.to_numpy(), return_counts=True)
    seeds = [zlib.crc32(i + b":") for i in ids]
    out, crc32 = [], zlib.crc32
    for doc, word in zip((pair // len(known)).tolist(), (pair % len(known)).tolist(), strict=True):
        w = known[word]
        h = crc32(w, seeds[doc])
        if h % EDIT_SHARE == 0:
            text = w.decode()
            at = h % len(text)
            w = (text[:at] + text[at + 1 :]).encode() if len(text) > LEAST_LENGTH else None
        out.append(w)
    return out, count


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): words of the documents (doc_id, text) with at least the least length and count."""

    def summed(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in slices(offsets):
                ids = [i.encode() for i in take(batch.column(0), np.arange(a, b)).to_pylist()]
                words, count = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ids)
                t = pa.table({"word": pa.array(words, pa.binary()), "n": count})
                held.append(t.filter(t["word"].is_valid()))
            if sum(map(len, held)) > HELD_ROWS:
                held = [summed(held)]
                if len(held[0]) > HELD_ROWS // 2:
                    yield from _strings(held.pop())
        if held:
            yield from _strings(summed(held))

    def _strings(t: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from pa.table({"word": t["word"].cast(pa.string()), "n": t["n"].cast(pa.int64())}).to_batches(20_000)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# -- tries inside a task --


class Node:
    """A branch of a compressed trie: ``depth`` characters of ``rep``, a word below, lead to it; ``ends``: words that end here."""

    __slots__ = ("children", "depth", "ends", "rep", "size")

    def __init__(self, depth: int, rep: str, ends: tuple[int, ...], children: dict[str, Node], size: int = 0):
        self.depth, self.rep, self.ends, self.children, self.size = depth, rep, ends, children, size


def common(a: str, b: str, at: int, stop: int) -> int:
    """Up to where, from ``at`` to ``stop``, two words agree."""
    if a[at:stop] == b[at:stop]:
        return stop
    while at < stop:
        half = (at + stop) // 2
        if a[at : half + 1] == b[at : half + 1]:
            at = half + 1
        else:
            stop = half
    return at


def trie(words: list[str]) -> list[Node]:
    """All nodes of the trie of sorted, different words, the root first; words are named by their places."""
    nodes: list[Node] = []
    todo: list[tuple[int, int, Node | None, str]] = [(0, len(words), None, "")]
    while todo:
        lo, hi, parent, c = todo.pop()
        first, last = words[lo], words[hi - 1]
        depth = common(first, last, parent.depth if parent else 0, min(len(first), len(last)))
        node = Node(depth, first, (lo,) if len(first) == depth else (), {}, hi - lo)
        nodes.append(node)
        if parent:
            parent.children[c] = node
        at = lo + len(node.ends)
        while at < hi:
            c = words[at][depth]
            end = bisect_right(words, c, at, hi, key=lambda w: w[depth])  # noqa: B023
            todo.append((at, end, node, c))
            at = end
    return nodes


class Merger:
    """Walks and merges subtrees; the pairs of words whose terminals coincide gather in ``pairs``."""

    def __init__(self) -> None:
        self.pairs: list[tuple[int, int]] = []

    def meet(self, a: tuple[int, ...], b: tuple[int, ...]) -> None:
        self.pairs.extend((i, j) for i in a for j in b)

    def walk(self, x: Node, y: Node, at: int, shift: int) -> None:
        """Follows x from depth ``at`` and y from ``at + shift`` as far as both go."""
        todo = [(x, y, at)]
        while todo:
            x, y, at = todo.pop()
            stop = min(x.depth, y.depth - shift)
            if x.rep[at:stop] != y.rep[at + shift : stop + shift]:
                continue
            if x.depth > stop:
                x_next = y.children.get(x.rep[stop])
                if x_next:
                    todo.append((x, x_next, stop))
            elif y.depth - shift > stop:
                y_next = x.children.get(y.rep[stop + shift])
                if y_next:
                    todo.append((y_next, y, stop))
            else:
                if x.ends and y.ends:
                    self.meet(x.ends, y.ends)
                few, many = (x.children, y.children) if len(x.children) <= len(y.children) else (y.children, x.children)
                todo.extend((x.children[c], y.children[c], stop) for c in few if c in many)

    def merge(self, into: dict[str, Node], c: str, y: Node, at: int) -> None:
        """Merges y, from depth ``at``, with the tree at into[c]; only nodes that both trees hold are made anew."""
        todo = [(into, c, y, at)]
        while todo:
            holder, c, y, at = todo.pop()
            x = holder.get(c)
            if x is None:
                holder[c] = y
                continue
            stop = min(x.depth, y.depth)
            part = common(x.rep, y.rep, at, stop)
            if part < stop:
                holder[c] = Node(part, x.rep, (), {x.rep[part]: x, y.rep[part]: y})
                continue
            upper, lower = (x, y) if x.depth <= y.depth else (y, x)
            new = holder[c] = Node(stop, upper.rep, upper.ends, dict(upper.children))
            if upper.depth < lower.depth:
                todo.append((new.children, lower.rep[stop], lower, stop))
                continue
            self.meet(x.ends, y.ends)
            new.ends = x.ends + y.ends
            todo.extend((new.children, k, child, stop) for k, child in lower.children.items())

    def at_node(self, node: Node) -> None:
        """All pairs whose words part at this node."""
        by_size = sorted(node.children.items(), key=lambda k: k[1].size)
        if not by_size:
            return
        d, (_, heavy), light = node.depth, by_size[-1], by_size[:-1]
        if node.ends and heavy.depth == d + 1 and heavy.ends:  # the heavy character skipped, nothing behind it
            self.meet(node.ends, heavy.ends)
        if not light:
            return
        replaced: dict[str, Node] = {}
        for c, x in light:
            self.merge(replaced, "", x, d + 1)  # both characters skipped
            self.walk(x, heavy, d, 1)  # the heavy one skipped
            if x.depth > d + 1:  # the light one skipped; the same character again parts further down
                k = x.rep[d + 1]
                if k != c and k in node.children:
                    self.walk(x, node.children[k], d + 1, -1)
                continue
            self.meet(x.ends, node.ends)
            for k, child in x.children.items():
                if k != c and k in node.children:
                    self.walk(child, node.children[k], d + 1, -1)
        self.walk(replaced[""], heavy, d + 1, 0)


def near_in_task(words: list[str]) -> list[tuple[int, int]]:
    """Places of the pairs of near words among sorted, different words, each pair once."""
    merger = Merger()
    if words:
        for node in trie(words):
            merger.at_node(node)
    return merger.pairs


# -- pairs over all words --

_LCP = "aggregate(sequence(0, 30), 0, (a, k) -> if(a + shiftleft(1, 30 - k) <= least(length(lo), length(hi)) and substr(lo, 1, a + shiftleft(1, 30 - k)) = substr(hi, 1, a + shiftleft(1, 30 - k)), a + shiftleft(1, 30 - k), a))"


def near_pairs(words: DataFrame, scratch: Scratch, group_words: int | None = None) -> DataFrame:
    """(a, a_n, b, b_n): each pair of near words once, from words (word, n), which are different and not null."""
    limit = group_words or GROUP_WORDS
    now, small, skips, tops = words.select("word", "n", F.lit("").alias("key")), [], [], []
    while True:
        groups = now.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("word").alias("lo"), F.max("word").alias("hi"))
        groups = scratch.keep(groups.where("size > 1").withColumn("d", F.when(F.col("size") > limit, F.expr(_LCP))).drop("lo", "hi"))
        joined = scratch.keep(frequent_join(now, groups, ["key"], "size"))
        small.append(joined.where("d is null").select("key", "word", "n"))
        if groups.where("d is not null").isEmpty():
            break
        top = joined.where("d is not null").select("word", "n", "d")
        longer = top.where(F.length("word") > F.col("d"))
        tops.append(top)
        skips.append(longer.select("word", "n", "d", F.expr("concat(substr(word, 1, d), substr(word, d + 2))").alias("skipped")))
        now = longer.select("word", "n", F.expr("substr(word, 1, d + 1)").alias("key"))

    def merged(table: pa.Table) -> pa.Table:
        t = table.sort_by("word")
        w, n = t["word"].to_pylist(), t["n"].to_numpy()
        at = np.array(near_in_task(w), np.int64).reshape(-1, 2)
        named = t["word"].combine_chunks()
        sides = [x for k in (0, 1) for x in (take(named, at[:, k]), pa.array(n[at[:, k]]))]
        return pa.table(sides, names=["a", "a_n", "b", "b_n"])

    below = small[0]
    for s in small[1:]:
        below = below.unionByName(s)
    out = below.groupBy("key").applyInArrow(merged, "a string, a_n long, b string, b_n long")
    if not skips:
        return out
    skip, top = skips[0], tops[0]
    for s, t in zip(skips[1:], tops[1:], strict=True):
        skip, top = skip.unionByName(s), top.unionByName(t)
    side = lambda df, c: df.select(F.col("word").alias(c), F.col("n").alias(f"{c}_n"), "d", "skipped")
    replaced = side(skip, "a").join(side(skip, "b"), ["d", "skipped"]).where("a < b")
    whole = top.withColumn("skipped", F.col("word"))
    deleted = side(skip, "a").join(side(whole, "b"), ["d", "skipped"]).where("substr(a, d + 1, 1) <> substr(b, d + 1, 1)")
    for part in (replaced, deleted):
        out = out.unionByName(part.select("a", "a_n", "b", "b_n"))
    return out


# -- forms and roots --


def _roots(hops: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): for each word of hops (word, form), the last word that forms lead to; every round doubles the steps."""
    now = hops.select("word", F.col("form").alias("root"))
    while True:
        met = now.groupBy("root").agg(F.count(F.lit(1)).alias("met"))
        on = scratch.keep(met.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root"))
        if on.isEmpty():
            return now
        now = scratch.keep(frequent_join(now, on, ["root"], "met", "left").select("word", F.coalesce("next", "root").alias("root")))


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the documents (doc_id, text).

    ``form``: the near word of largest n, if that is at least twice the word's own; ``root``: where forms lead to, or the word
    itself; ``n_near``: how many near words there are.
    """
    scratch = Scratch(docs.sparkSession, "errata")
    words = scratch.keep(word_counts(docs))
    pairs = near_pairs(words, scratch)
    none = F.lit(None).cast("string").alias("other")
    seen = words.select("word", "n", none, F.lit(None).cast("long").alias("other_n"))
    for a, b in (("a", "b"), ("b", "a")):
        seen = seen.unionByName(pairs.select(F.col(a).alias("word"), F.col(f"{a}_n").alias("n"), F.col(b).alias("other"), F.col(f"{b}_n").alias("other_n")))
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other")))).alias("best")
    near = seen.groupBy("word").agg(F.max("n").alias("n"), F.count("other").alias("n_near"), best)
    follows = -F.col("best.less") >= FORM_RATIO * F.col("n")
    formed = scratch.keep(near.select("word", "n", "n_near", F.when(follows, F.col("best.other")).alias("form"), F.when(follows, -F.col("best.less")).alias("form_n")))
    roots = _roots(formed.where("form is not null"), scratch)
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
