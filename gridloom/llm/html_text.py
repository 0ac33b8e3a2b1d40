"""Main text of web pages by consensus host paths.

Each page's containers are scored by the running text of their blocks; the best container's generalised tag-class path is a
vote of its host. Votes are summed in Spark, and every page is extracted again at its host's winning paths. A page on which
no winning path occurs, or whose host is unknown, is extracted at its own best container. So is a page of a layout of its own, on
which a winning path occurs as something lesser, a teaser say: where the same best container stands beside the same winning path
on several pages of a host, that is what the host does there, and not one page's oddity.

A page is read in one pass whose cost grows with its length alone, however deep, long or broken it is.

Defined cases: null or empty html gives an empty text; a null or odd url has no host and takes no part in votes; a page whose
containers hold no running text gives what text its body has outside boilerplate; repeated rows and null ids are pages of
their own; very long and very deep pages are read whole; broken markup (unclosed or stray tags) is repaired as browsers do for
the common cases; a tag whose quotation never ends, ends at its first ``>``, and so do all later tags of that page; an empty
table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, frequent_join, trim

#: Elements of HTML by their role in a text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
BAD_TAGS = frozenset("nav footer aside form button menu dialog fieldset label header".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentary cookie cookies consent "
    "disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination "
    "popup promo promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar tracking widget".split()
)
GOOD_WORDS = frozenset("article articlebody body content entry main post story text".split())
SEALED = frozenset("article main body html".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}}

MARK = re.compile(r"<(?=([!?/a-zA-Z]))(?!/[^a-zA-Z]|/\Z)")
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
TURN = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>]+)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
LONG_NUMBER = re.compile(r"&#(?=[0-9]{8})0*([0-9]+);?")
#: Votes of a host that a path needs, as a share of the host's best.
SHARE = 0.1
PATHS = 3
#: Pages of a host on which one best container beats one winning path, from which on it is taken there.
TOGETHER = 2
#: Steps of a path that its text shows; all of them count.
SHOWN = 32
#: Hosts up to which their paths are broadcast (a few hundred bytes each), else only frequent hosts' are.
BROADCAST_HOSTS = 100_000


class Page:
    """A page's elements (parent first) and its texts in page order; a text of None ends a block."""

    def __init__(self, source: str):
        self.tags, self.names, self.parents, self.bad = ["#root"], [""], [-1], [0]
        self.texts: list[tuple[int, str | None]] = []
        self._read(source)

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}
        name = (found.get("class") or "").strip()
        bad = tag in BAD_TAGS
        if found:
            for word in [*name.split(), found.get("id") or ""]:
                parts = [w.lower() for w in WORDS.findall(word)]
                if parts and parts[0] not in ("has", "with", "no", "without", "is", "js") and not (parts[-1] in GOOD_WORDS) and any(w in BAD_WORDS for w in parts):
                    bad = True
            style = (found.get("style") or "").replace(" ", "").lower()
            bad = bad or (found.get("role") or "").lower() in BAD_ROLES or "hidden" in found or (found.get("aria-hidden") or "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
        self.tags.append(tag), self.names.append(name), self.parents.append(parent), self.bad.append(1 if bad and tag not in ("html", "body") else 0)
        return len(self.tags) - 1

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        texts, tags = self.texts, self.tags
        stack = [0]
        where: dict[str, list[int]] = {}  # places in the stack of each open tag
        blocks: list[int] = []  # places in the stack of open blocks
        unclosed: set[str] = set()
        quoted = True  # do quotations hide the end of a tag?

        def cut(k: int) -> None:
            for i in stack[k:]:
                where[tags[i]].pop()
            del stack[k:]
            while blocks and blocks[-1] >= k:
                blocks.pop()

        def last(names) -> int:
            return max((where[n][-1] for n in names if where.get(n)), default=0)

        while at < end:
            mark = MARK.search(source, at)
            if not mark:
                texts.append((stack[-1], source[at:]))
                break
            begin, after = mark.start(), mark[1]
            closing = after == "/"
            name = NAME.match(source, begin + 1 + closing)
            if not name:
                final = "-->" if source.startswith("<!--", begin) else ">"
                stop = source.find(final, begin + 2)
                following = end if stop < 0 else stop + len(final)
            else:
                stop = name.end()
                while quoted:
                    turn = TURN.search(source, stop)
                    if not turn:
                        quoted = False
                    elif turn[0] == ">":
                        stop = turn.start()
                        break
                    else:
                        stop = source.find(turn[0], turn.end()) + 1
                        quoted = stop > 0
                if not quoted:
                    stop = source.find(">", name.end())
                    if stop < 0:
                        texts.append((stack[-1], source[at:]))
                        break
                following = stop + 1
            if begin > at:
                texts.append((stack[-1], source[at:begin]))
            at = following
            if not name:
                continue
            tag, attributes = name[0].lower(), source[name.end() : stop]
            block = tag in BLOCK
            if closing:
                if tag == "p" and not where.get("p"):
                    texts.append((stack[-1], None))
                elif tag not in VOID and tag not in ("html", "body") and where.get(tag):
                    k, top = where[tag][-1], blocks[-1] if blocks else 0
                    if block or k > top:  # an inline end tag doesn't close blocks
                        if top >= k:
                            texts.append((stack[k], None))
                        cut(k)
                continue
            if block:
                texts.append((stack[-1], None))
                if blocks and tags[stack[blocks[-1]]] == "p":
                    cut(blocks[-1])
                if tag in CLOSES:
                    k = last(CLOSES[tag])
                    if k > last(WALLS[tag]):
                        cut(k)
                        while len(stack) > 1 and tags[stack[-1]] in CLOSES[tag]:
                            cut(len(stack) - 1)
            if tag in RAW:
                close = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                if close:
                    at = close.end()
                else:
                    unclosed.add(tag)
                    at = end if tag in ("script", "style", "textarea", "title") else at
                continue
            if tag == "br":
                texts.append((stack[-1], " "))
            if tag in VOID or attributes.endswith("/") and not block:
                if tag == "hr":
                    texts.append((stack[-1], None))
                continue
            if tag in ("html", "body") and where.get(tag):
                continue
            where.setdefault(tag, []).append(len(stack))
            if block:
                blocks.append(len(stack))
            stack.append(self._open(tag, attributes, stack[-1]))

    def hidden(self) -> list[bool]:
        """Per element: is it, or is it in, boilerplate?"""
        out: list[bool] = []
        for bad, parent in zip(self.bad, self.parents, strict=True):
            out.append(bool(bad) or (parent >= 0 and out[parent]))
        return out

    def step(self, node: int) -> str:
        """A tag with its classes, digits and long hashes taken out."""
        names = sorted({re.sub(r"\d+|[0-9a-f]{8,}", "#", n) for n in self.names[node].split()}) if self.names[node] else ()
        return ".".join([self.tags[node], *names])

    def keys(self) -> list[str]:
        """Per element: a digest of the generalised path from the root."""
        out, steps = [""], [bytes(16)]
        for node in range(1, len(self.tags)):
            steps.append(hashlib.blake2b(steps[self.parents[node]] + self.step(node).encode("utf-8", "surrogatepass"), digest_size=16).digest())
            out.append(steps[node].hex())
        return out

    def path(self, node: int) -> str:
        """The last steps of the generalised path, for people to read."""
        steps = []
        while node > 0 and len(steps) < SHOWN:
            steps.append(self.step(node))
            node = self.parents[node]
        return ">".join(reversed(steps + ["..."] if node > 0 else steps))

    def best(self) -> tuple[int, float]:
        """The container with the most running text, raised to the article or main element around it, and its score.

        Without one, it is raised while the element around it holds further running text, or a first heading.
        """
        hidden = self.hidden()
        score: dict[int, float] = {}
        running = [0] * len(self.tags)
        links, box = [False] * len(self.tags), [0] * len(self.tags)  # is it in a link? the block that it is, or is in
        for i, p in enumerate(self.parents):
            links[i] = self.tags[i] == "a" or (p >= 0 and links[p])
            box[i] = i if p < 0 or self.tags[i] in BLOCK else box[p]
        length = linked = commas = 0
        holder = -1

        def done() -> None:
            nonlocal length, linked, commas, holder
            if holder >= 0 and 2 * linked < length and (length - linked >= 25 or self.tags[holder] == "h1"):
                running[holder] += length - linked
            if length - linked >= 25 and holder >= 0:
                points = (1 + commas + (length - linked) / 100) * (1 - linked / length)
                node, part = holder, 1.0
                for _ in range(2):
                    node = self.parents[node]
                    if node < 0:
                        break
                    node = box[node]
                    score[node] = score.get(node, 0) + points * part
                    part /= 2
            length = linked = commas = 0
            holder = -1

        for node, text in self.texts:
            if text is None:
                done()
            elif not hidden[node] and not text.isspace():
                n = len(text)
                length, linked, commas = length + n, linked + n * links[node], commas + text.count(",")
                if holder < 0:
                    holder = box[node]
        done()
        for i in range(len(self.tags) - 1, 0, -1):
            running[self.parents[i]] += running[i]
        for node in score:
            words = {w.lower() for w in WORDS.findall(self.names[node])}
            if self.tags[node] in ("article", "main") or words & GOOD_WORDS:
                score[node] *= 1.25
        if not score:
            return max((i for i, t in enumerate(self.tags) if t == "body"), default=0), 0.0
        node = max(score, key=lambda k: (score[k], -k))
        value, up, whole = score[node], node, -1
        while up > 0:
            if self.tags[up] == "article" or self.tags[up] == "main" and whole < 0:
                whole = up
            up = self.parents[up]
        if whole > 0:
            return whole, value
        up = self.parents[node]
        while up > 0 and self.tags[up] != "html" and self.tags[node] not in SEALED:
            if running[up] > running[node]:
                node = up
            up = self.parents[up]
        return node, value

    def extract(self, roots: set[int]) -> str:
        """The text in ``roots`` outside boilerplate: blocks in page order, white space made single, joined by blank lines."""
        inside: list[bool] = []
        headed = self._headed()
        for i, (bad, parent) in enumerate(zip(self.bad, self.parents, strict=True)):
            keep = i in roots or (parent >= 0 and inside[parent] and (not bad or i in headed))
            inside.append(keep)
        blocks, now = [], []

        def done() -> None:
            if now:
                text = " ".join(decoded("".join(now)).split())
                if text:
                    blocks.append(text)
                now.clear()

        for node, text in self.texts:
            if text is None:
                done()
            elif inside[node]:
                now.append(text)
        done()
        return "\n\n".join(blocks)

    def _headed(self) -> set[int]:
        """Header elements in an article that hold its first heading: part of the article, not of the page's frame."""
        inside = [False] * len(self.tags)  # is an article around it?
        for i, p in enumerate(self.parents):
            inside[i] = p >= 0 and (inside[p] or self.tags[p] == "article")
        out: set[int] = set()
        seen: set[int] = set()
        for i, tag in enumerate(self.tags):
            k = self.parents[i]
            while tag == "h1" and inside[i] and k not in seen and self.tags[k] != "article":
                seen.add(k)
                if self.tags[k] == "header":
                    out.add(k)
                k = self.parents[k]
        return out

    def both_texts(self, paths: list[str]) -> tuple[str, str | None, str | None]:
        """Text at the first of ``paths`` (keys of them) that occurs, or at the page's own best container.

        Where these two differ and the best container holds more running text: also the text there, and a digest of both paths.
        """
        node, score = self.best()
        if paths:
            hidden, keys, roots = self.hidden(), self.keys(), {p: set() for p in paths}
            for i, key in enumerate(keys):
                if key in roots and not hidden[i]:
                    roots[key].add(i)
            for p in paths:
                if roots[p] and (text := self.extract(roots[p])):
                    if score > 0 and keys[node] != p and len(own := self.extract({node})) > len(text):
                        return text, own, hashlib.blake2b((p + keys[node]).encode(), digest_size=16).hexdigest()
                    return text, None, None
        return self.extract({node}), None, None

    def main_text(self, paths: list[str]) -> str:
        """Text at the first of ``paths`` that occurs, or at the page's own best container."""
        return self.both_texts(paths)[0]


def decoded(text: str) -> str:
    """Text with its character references decoded; numbers beyond any character are the replacement character."""
    return html.unescape(LONG_NUMBER.sub(lambda m: f"&#{m[1]};" if len(m[1]) < 8 else "\ufffd", text) if "&#" in text else text)


def host_of(url):
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """host, key, path, pages, score: pages and scores summed per host and generalised path of the best container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, keys, paths, scores = [], [], [], []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = Page(source.as_py())
                node, score = page.best()
                if score > 0:
                    hosts.append(host), keys.append(page.keys()[node]), paths.append(page.path(node)), scores.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], names=["host", "key", "path", "score"])

    known = pages.select(host_of(F.col("url")).alias("host"), "html").where((F.col("host") != "") & F.col("html").isNotNull())
    each = known.mapInArrow(run, "host string, key string, path string, score double")
    return each.groupBy("host", "key").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("pages"), F.sum("score").alias("score"))


def winners(found: DataFrame) -> DataFrame:
    """host, keys, pages: the keys of a host's few paths with the most pages, then score, and the pages of all its paths."""
    host = Window.partitionBy("host")
    order = host.orderBy(F.col("pages").desc(), F.col("score").desc(), "key")
    most, every = F.max("pages").over(host).alias("most"), F.sum("pages").over(host).alias("every")
    top = found.select("host", "key", "pages", F.row_number().over(order).alias("n"), most, every)
    kept = top.where((F.col("n") <= PATHS) & (F.col("pages") >= SHARE * F.col("most")))
    return kept.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("k"), F.max("every").alias("pages")).select("host", F.col("k.key").alias("keys"), "pages")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html)."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, keys in zip(batch.column(3), batch.column(4).to_pylist(), strict=True):
                source = source.as_py()
                texts.append(Page(source).both_texts(keys or []) if source else ("", None, None))
            columns = [pa.array([t[i] for t in texts], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["page_id", "url", "host", "text", "own", "pair"])
        trim()

    scratch, own = Scratch(pages.sparkSession, "hosts"), pages.select("page_id", "url", "html")
    won = scratch.keep(winners(votes(own)))
    hosted = own.withColumn("host", host_of(F.col("url")))
    if won.count() <= BROADCAST_HOSTS:
        joined = hosted.join(F.broadcast(won), "host", "left")
    else:  # pages of frequent hosts stay where they are
        joined = frequent_join(hosted, won, ["host"], "pages", "left")
    read = scratch.keep(joined.select("page_id", "url", "host", "html", "keys").mapInArrow(run, f"page_id {kind}, url string, host string, text string, own string, pair string"))
    together = scratch.keep(read.where(F.col("pair").isNotNull()).groupBy("host", "pair").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= TOGETHER))
    odd = frequent_join(read.where(F.col("pair").isNotNull()), together, ["host", "pair"], "pages", "left")
    text = F.when(F.col("pages").isNotNull(), F.col("own")).otherwise(F.col("text"))
    done = read.where(F.col("pair").isNull()).select("page_id", "url", "text").unionByName(odd.select("page_id", "url", text.alias("text")))
    return done.withColumn("n_chars", F.length("text").cast("long"))
