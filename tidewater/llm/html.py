"""HTML extraction by consensus host paths.

Each page's containers are scored by the running text in them; every page votes for the generalised tag-class paths of
its containers; the votes are summed per host in Spark, and each page is extracted again from the containers on its
host's winning path. A page without that path, or without a host, is extracted from its own best container.

What is removed inside the winner is settled in the same way: every page reports what stands on each of its named paths,
and a path whose text recurs on the host's other pages, or is links, on most of its pages is the host's furniture. What
a single page can tell by itself, its tags and the words of class, id and role, is a weaker sign that serves where a
host has few pages: words that also occur in articles count only among other words of layout.

A page is read in one pass, in time and memory in proportion to its length, however its tags are nested or left open.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidewater.llm.storage import small_side, written
from tidewater.llm.textkit import pieces
from tidewater.llm.urls import host_and_path

_NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
_MARK = re.compile(r"[>\"']")
_NAMES = re.compile(r"(?:\s|^)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "title"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul center dialog menu".split())
_HOLDER = {"article", "main", "section", "div", "td", "body"}
_NEVER = {"nav", "footer", "aside", "form", "head", "button", "select", "dialog", "menu", "label", "input"} | _RAW
#: Form controls within a line: their text goes, the line around them stays one block.
_INLINE = {"button", "select", "label"}
#: Words in class, id or role that mark what is not the article, in the languages of the corpus; fixed values. The first
#: count wherever they occur, the second only where a name holds nothing but them and words of layout.
_NOISE = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "newsletter subscribe comment comments commentlist disqus footer copyright pager pagination toolbar masthead widget "
    "kommentar kommentare commentaire commentaires comentario comentarios werbung anzeige anzeigen publicidad publicite reklame".split()
)
_PERHAPS = set("side related recommended share sharing social promo promotion banner notice alert signup login reply replies foot search skip discussion feedback reactions responses".split())
_LAYOUT = set("box boxes bar list lists links link wrap wrapper block blocks area item items container content button buttons post posts left right top bottom inner outer small site page reader user form section main col column row grid body text id js is has the and with for".split())
#: Tags that hold a page or its article: their class words tell of the layout around them.
_PAGE = {"html", "body", "main", "article"}
_ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.IGNORECASE)
_HREF = re.compile(r"(?:\A|\s)href\s*=", re.IGNORECASE)
_CLOSES_P = _BLOCK - {"br", "html", "body"}


def _tags(html: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, name, closes, rest) of each tag, name None for comments and declarations; quotes may hide a ``>``.

    After a tag whose quotes never end, quotes hide nothing any more, so no text is scanned again and again. A raw
    element (script and the like) ends at its end tag; without one, script and style end with the page, and of others only
    the tag itself is left out.
    """
    at, size, quoted = 0, len(html), True
    unclosed: set[str] = set()
    while True:
        start = html.find("<", at)
        if start < 0 or start + 1 >= size:
            return
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = size if end < 0 else end + 3
            yield start, at, None, False, ""
            continue
        if html[start + 1] in "!?":
            end = html.find(">", start)
            at = size if end < 0 else end + 1
            yield start, at, None, False, ""
            continue
        m = _NAME.match(html, start + 1)
        if m is None:
            if html[start + 1] == "/" and (end := html.find(">", start)) >= 0:
                at = end + 1
                yield start, at, None, False, ""
            else:
                at = start + 1
            continue
        end = _tag_end(html, m.end()) if quoted else html.find(">", m.end())
        if end < 0 and quoted:
            quoted = False
            end = html.find(">", m.end())
        if end < 0:
            return
        name, rest = m[2].lower(), html[m.end() : end]
        at = end + 1
        if name in _RAW and not m[1] and not rest.rstrip().endswith("/"):
            close = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(html, at)
            if close:
                at = close.end()
            elif name in ("script", "style"):
                at = size
            else:
                unclosed.add(name)
            yield start, at, None, False, ""
            continue
        yield start, at, name, bool(m[1]), rest


def _tag_end(html: str, at: int) -> int:
    """Place of the ``>`` outside quotes, or -1."""
    while m := _MARK.search(html, at):
        if m[0] == ">":
            return m.start()
        at = html.find(m[0], m.end()) + 1
        if at == 0:
            return -1
    return -1


class Page:
    """A page's containers and text blocks, read in one pass that forgives unclosed and stray tags.

    Node 0 stands for the body where a page has no such tag. A node's number is above its parent's.
    """

    def __init__(self, html: str):
        self.parent, self.path, self.noise, self.kind = [-1], [_digest("", "")], [False], ["body"]
        self._marked = [False]  # by words of class, id or role
        self.named: list[int | None] = [None]  # the path of nodes with a class or id, every tag counted
        self._named_below = [1]
        self._within = [0]  # 1 inside article or main, 2 inside an article
        self.blocks: list[tuple[int, str, int]] = []  # (node, text, characters in links)
        self._parts: list[str] = []
        self._linked = 0
        stack: list[tuple[str, int]] = [("", 0)]
        open_tags: Counter[str] = Counter()
        links, loose, at, muted = 0, False, 0, 0

        def around() -> int:  # what holds the text: no control within its line
            return stack[-1][1] if not muted else next(n for name, n in reversed(stack) if name not in _INLINE)

        for start, end, name, closes, rest in _tags(html):
            if start > at and not muted:
                self._text(html[at:start], links)
            at = end
            if name is None:
                continue
            if name in _BLOCK and name != "br" and loose:
                # An anchor without an end tag ends with its line of text.
                self._cut(around())
                links, loose = 0, False
            if closes:
                if name in _BLOCK:
                    self._cut(around())
                if name == "a":
                    links, loose = 0, False
                while open_tags[name]:
                    top = stack.pop()[0]
                    open_tags[top] -= 1
                    muted -= top in _INLINE
                    if top == name:
                        break
                continue
            if name in _BLOCK:
                self._cut(around())
                if stack[-1][0] == "head":
                    open_tags[stack.pop()[0]] -= 1
            if name in _VOID:
                continue
            if name == "a":
                following = _ANCHOR.search(html, at)
                links = int(_HREF.search(rest) is not None)
                loose = links > 0 and not (following and following[1])
                continue
            if name not in _BLOCK and name not in _NEVER:
                continue
            if name in _CLOSES_P and stack[-1][0] == "p" or name == "li" and stack[-1][0] == "li":
                open_tags[stack.pop()[0]] -= 1
            self._open(name, rest, stack[-1][1])
            stack.append((name, len(self.parent) - 1))
            open_tags[name] += 1
            muted += name in _INLINE
        if at < len(html) and not muted:
            self._text(html[at:], links)
        self._cut(around())
        self._judge()

    def _open(self, name: str, rest: str, top: int) -> None:
        names = " ".join(x for y in _NAMES.findall(rest) for x in y).lower() if rest else ""
        inside = self._within[top] > 0
        exempt = name in _PAGE and not (name == "article" and self._within[top] == 2)
        self._marked.append(not exempt and any(_is_noise(set(filter(None, re.split(r"[^a-z]+", x))), inside) for x in names.split()))
        label = ".".join([name, *sorted(set(re.sub(r"\d+", "#", names).split()))]) if names else name
        below = _step(self._named_below[top], label)
        self._named_below.append(below)
        self.named.append(_signed(below) if names and not exempt else None)
        self.parent.append(top)
        if name in _HOLDER:
            self.path.append(_digest(self.path[top], label))
        else:
            self.path.append(self.path[top])
        self.noise.append(name in _NEVER or (not inside and name == "header"))
        self.kind.append(name)
        self._within.append(2 if name == "article" else max(self._within[top], int(name == "main")))

    def _judge(self) -> None:
        """Noise passes down. Words do not make noise of a container with most of the page's unlinked text that also has
        its heading or main part, or that has all of it."""
        self._hide(self._marked)

    def without(self, furniture: set[int]) -> None:
        """Hide the nodes on the host's furniture paths, but for those that hold most of what is left of the page's text."""
        if furniture:
            self._hide([p in furniture for p in self.named], most=True)

    def _hide(self, marked: list[bool], *, most: bool = False) -> None:
        nodes = len(self.parent)
        held, headed, total = [0] * nodes, [k in ("h1", "main") for k in self.kind], 0
        if any(marked):
            plain = list(self.noise)
            for n in range(1, nodes):
                plain[n] = plain[n] or plain[self.parent[n]]
            for node, text, linked in self.blocks:
                worth = len(text) - 2 * linked
                if worth > 0 and not plain[node]:
                    total += worth
                    held[node] += worth
            for n in range(nodes - 1, 0, -1):
                held[self.parent[n]] += held[n]
                headed[self.parent[n]] = headed[self.parent[n]] or headed[n]
        for n in range(1, nodes):
            spared = 2 * held[n] > total and (most or (self.kind[n] in _HOLDER and (headed[n] or held[n] == total)))
            self.noise[n] = self.noise[n] or self.noise[self.parent[n]] or (marked[n] and not spared)

    def reports(self) -> list[tuple[int, int, bool]]:
        """(path, text, linked) of each named node that has text and is not noise by its tags: a number for the texts of its
        blocks, and whether most of it is in links."""
        nodes = len(self.parent)
        chars, links, text = [0] * nodes, [0] * nodes, [0] * nodes
        for node, said, linked in self.blocks:
            chars[node] += len(said)
            links[node] += linked
            text[node] += xxh64_intdigest(said.encode())
        for n in range(nodes - 1, 0, -1):
            up = self.parent[n]
            chars[up], links[up], text[up] = chars[up] + chars[n], links[up] + links[n], text[up] + text[n]
        self.whole = _signed(text[0])
        return [(p, _signed(text[n]), 2 * links[n] > chars[n]) for n, p in enumerate(self.named) if p is not None and chars[n]]

    def _text(self, raw: str, links: int) -> None:
        self._parts.append(raw)
        if links:
            self._linked += len(raw.strip())

    def _cut(self, node: int) -> None:
        if self._parts:
            text = " ".join(unescape("".join(self._parts)).split())
            if text:
                self.blocks.append((node, text, self._linked))
            self._parts, self._linked = [], 0

    def scores(self) -> dict[int, float]:
        """Per container outside menus, adverts and the like: four times its blocks' unlinked characters, halved for each
        further container around them."""
        bodies = "body" in self.kind[1:]
        own = [0.0] * len(self.parent)
        for node, text, linked in self.blocks:
            worth = len(text) - 2 * linked
            if worth > 0 and not self.noise[node]:
                own[node] += 4.0 * worth
        found: dict[int, float] = {}
        for n in range(len(self.parent) - 1, -1, -1):
            if own[n] and self.kind[n] in _HOLDER and (n or not bodies):
                found[n] = own[n]
                own[n] /= 2
            if n:
                own[self.parent[n]] += own[n]
        return found

    def best(self) -> int | None:
        """The container with the largest score, the first of several."""
        found = self.scores()
        return min(found, key=lambda n: (-found[n], n)) if found else None

    def text(self, chosen: set[int]) -> str:
        """The blocks in the chosen containers without those of menus, adverts, comments and the like."""
        inside = [n in chosen for n in range(len(self.parent))]
        for n in range(1, len(inside)):
            inside[n] = inside[n] or inside[self.parent[n]]
        return "\n".join(t for node, t, _ in self.blocks if inside[node] and not self.noise[node])


def _is_noise(words: set[str], inside: bool) -> bool:
    """Whether one name's words mark what is not the article; ``inside`` article or main, a header is the article's."""
    perhaps = _PERHAPS if inside else _PERHAPS | {"header"}
    return bool(words & _NOISE) or (bool(words & perhaps) and words <= perhaps | _LAYOUT)


def _step(path: int, label: str) -> int:
    """A path one label longer, as a number of 64 bits."""
    return (path * 0x9E3779B97F4A7C15 + xxh64_intdigest(label.encode())) % (1 << 64)


def _signed(number: int) -> int:
    return number % (1 << 64) - (1 << 63)


def _digest(path: str, label: str) -> str:
    """A container's path as 16 hex digits: its parent's and its own label, so paths take the same room at any depth."""
    return blake2b(f"{path}/{label}".encode(), digest_size=8).hexdigest()


def votes(html: str) -> list[tuple[str, int]]:
    """The generalised paths of a page's containers, with each one's share of the best score in per mille (0: no vote)."""
    return _votes(Page(html))


def _votes(page: Page) -> list[tuple[str, int]]:
    by_path: dict[str, float] = {}
    for n, s in page.scores().items():
        by_path[page.path[n]] = by_path.get(page.path[n], 0) + s
    top = max(by_path.values(), default=0)
    return [(p, n) for p, s in sorted(by_path.items()) if (n := int(1000 * s / top))]


def main_text(html: str | None, winner: str | None, furniture: list[int] | None = None) -> str:
    """The article's text by the winning path, or by the page's own best container where the path is not there, without the
    host's furniture."""
    if not html:
        return ""
    page = Page(html)
    page.without(set(furniture or ()))
    chosen = {n for n in range(1, len(page.path)) if page.path[n] == winner and page.kind[n] in _HOLDER and not page.noise[n]} if winner else set()
    if not chosen or not (text := page.text(chosen)):
        own = page.best()
        text = page.text({own}) if own is not None else ""
    return text


#: Pages of a host that must have a path before it can be furniture, and the share of them where its text recurs or is links.
LEAST_PAGES, SHARE = 4, 0.6


def ballots(pages: DataFrame) -> DataFrame:
    """What the pages of each host say, summed up: (host, path, n) for containers' votes, and (host, named, text, n, recurs,
    linked) for the texts on named paths. ``pages`` has host and html; pages without a host or html say nothing. Pages with
    the same text throughout are one page's copies, and say nothing about what recurs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html"):
                rows = []
                for host, html in zip(part.column("host").to_pylist(), part.column("html"), strict=True):
                    page = Page(html.as_py() or "")
                    rows += [(host, path, None, None, n, None, None) for path, n in _votes(page)]
                    found = page.reports()
                    rows += [(host, None, path, text, 1, page.whole, linked) for path, text, linked in found]
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                columns = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "path", "named", "text", "n", "whole", "linked"])

    cast = pages.filter("host <> ''").select("host", "html").mapInArrow(read, "host string, path string, named long, text long, n long, whole long, linked boolean")
    return cast.groupBy("host", "path", "named", "text").agg(F.sum("n").alias("n"), (F.min("whole") < F.max("whole")).alias("recurs"), F.count_if("linked").alias("linked"))


def host_paths(said: DataFrame) -> DataFrame:
    """(host, path): each host's winning path, by summed votes and, of equal ones, the first path."""
    return said.filter("path IS NOT NULL").groupBy("host").agg(F.min_by("path", F.struct(-F.col("n"), "path")).alias("path"))


def host_furniture(said: DataFrame) -> DataFrame:
    """(host, furniture): the named paths whose text stands on other pages of the host too, or is mostly links, on at least
    SHARE of the path's pages, of which there are LEAST_PAGES."""
    by_path = said.filter("named IS NOT NULL").groupBy("host", "named").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("recurs"), F.col("n")).otherwise(0)).alias("recurs"), F.sum("linked").alias("linked"))
    voted = by_path.filter((F.col("n") >= LEAST_PAGES) & (F.greatest("recurs", "linked") >= SHARE * F.col("n")))
    return voted.groupBy("host").agg(F.sort_array(F.collect_list("named")).alias("furniture"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``, which needs page_id, url and html.

    Null html or html without an article gives an empty text; a null url has no host. Repeated rows are extracted
    alike, an empty table gives no rows, other columns are not read. The winning paths and furniture, one row a host, are
    broadcast while they are few; beyond that the pages are joined by a shuffle, in which adaptive execution splits a
    host with a third of all pages, as nothing after the join needs a host's pages together.
    """
    host, _ = host_and_path(F.col("url"))
    given = pages.select("page_id", "url", "html", host.alias("host"))
    said = written(ballots(given), "host-ballots")
    winners = written(host_paths(said).withColumnRenamed("path", "winner").join(host_furniture(said), "host", "left"), "host-paths")
    joined = given.join(small_side(winners), "host", "left").select("page_id", "url", "html", "winner", "furniture")
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html", 1 << 23):
                columns = (part.column(c) for c in ("html", "winner", "furniture"))
                texts = [main_text(*(x.as_py() for x in row)) for row in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
