"""Main text of web pages by text-to-tag ratios.

The standard library's streaming parser turns a page into events; these make blocks (what a reader sees as
a line or paragraph), each with its letters, its tags and its place in the page. Menus, headers, footers, side bars, notices,
adverts, forms, comments of readers, scripts and styles are known by their element, role or class and
give no blocks. A form or a name in class or id is only suspect: such an element is read as usual if no article stands outside of such and it holds more than half of the letters in dense
blocks, or if it holds all articles of the page and more such letters than stand outside of suspects (comments of readers do not count and stay out). The ratio of letters to tags of each block is smoothed with a Gaussian along the page; blocks
above the threshold form the content clusters. The innermost element that holds four fifths of the clusters' letters is the article, or an
``article`` or ``main`` that holds half of them; all its blocks are kept, a paragraph of one word too. If only the page itself holds the clusters, what lies between the first and the
last is kept, and headings and paragraphs that touch them.

Elements are numbered with links to their parents, so a page costs what its length is, however deep it is nested.

Defined results: null or empty pages, and pages with no text outside the named parts, give empty text. Unclosed,
crossed or cut markup is closed as far as needed; a comment that never ends reaches to the end of the page. Nothing is cut by length. Rows are handled one by one, so repeated
rows give repeated rows; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vacantia.llm.common import keyed, ship, slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
CONTAINER = frozenset("article body div html main section table td".split())
UNSEEN = frozenset("audio button canvas datalist dialog head iframe noscript object script select style svg template textarea title video".split())
APART = frozenset("aside footer menu nav search".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer "
    "form login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted recommended related "
    "reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
PROSE = frozenset("blockquote h1 h2 h3 h4 h5 h6 p pre".split())
HEADS = frozenset("header masthead banner".split())
THREADS = frozenset("comment comments disqus reply replies respond".split())
#: What follows these in a name tells what an element has beside it, or lacks.
BESIDE = frozenset("has no with without".split())
PART = re.compile("[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
END_OF_COMMENT = re.compile(r"--!?\s*>")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def names_of(value: str) -> set[str]:
    """Lower-case parts of the words of a class or id, up to one of ``BESIDE``."""
    out = set()
    for word in value.split():
        for part in PART.findall(word):
            if part.lower() in BESIDE:
                break
            out.add(part.lower())
    return out


class Block(NamedTuple):
    text: str
    tags: int
    element: str  # that it is the text of
    container: int  # number of the innermost one, -1 for none
    suspect: int  # number of the innermost one, -1 for none


class Blocks(HTMLParser):
    """Events to blocks. ``free``: numbers of the suspect elements that are read as usual; null for all."""

    def __init__(self, free: frozenset[int] | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.free = free
        self.count = 0  # elements so far
        self.doubted = False
        self.suspects: list[int] = []  # parents of suspects, by the order in which they open
        self.numbers: list[int] = []  # and their numbers as elements
        self.threads: list[bool] = []  # and whether they, or one around them, hold comments of readers
        self.anchors: list[int] = []  # innermost suspect around each article or main
        self.containers: list[int] = []  # parents of containers
        self.kinds: list[str] = []
        self.blocks: list[Block] = []
        self.buffer: list[str] = []
        self.tags = 0
        self.stack: list[tuple[str, bool, int, int]] = []  # element, whether it gives no blocks, innermost container and suspect outside it
        self.open: Counter[str] = Counter()
        self.shut = 0  # open elements that give no blocks
        self.container = self.suspect = -1

    def parse_comment(self, i: int, report: bool = True) -> int:
        if not END_OF_COMMENT.search(self.rawdata, i + 4):
            return len(self.rawdata)
        return super().parse_comment(i, report)

    def flush(self, element: str | None = None) -> None:
        if self.buffer:
            if text := " ".join("".join(self.buffer).split()):
                element = element or next((t for t, *_ in reversed(self.stack[-8:]) if t in BLOCK), "")
                self.blocks.append(Block(text, self.tags, element, self.container, self.suspect))
            self.buffer = []
            self.tags = 0

    def apart(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in UNSEEN or tag in APART or tag == "header" and not self.open["article"]:
            return True
        if tag in ("html", "body", "article", "main"):
            return False
        return any(k == "hidden" or v and (k == "role" and v.strip().lower() in ROLES or k == "aria-hidden" and v == "true" or k == "style" and HIDDEN.search(v.lower())) for k, v in attrs)

    def against(self, tag: str, attrs: list[tuple[str, str | None]]) -> set[str]:
        """Names that speak against an element."""
        found = {"form"} if tag == "form" else set()
        if tag in ("html", "body", "article", "main"):
            return found
        for k, v in attrs:
            if v and k in ("class", "id"):
                names = names_of(v) & (NAMES | HEADS)
                if names - HEADS or names and not self.open["article"]:
                    found |= names
        return found

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
            if self.open["p"]:
                self.close_to("p")
        elif tag in ("br", "td", "th"):
            self.buffer.append(" ")
        if tag in VOID:
            return
        if tag in ("li", "dt", "dd", "option") and self.stack and self.stack[-1][0] == tag:
            self.close_to(tag)
        apart = bool(self.apart(tag, attrs))
        self.count += 1
        names = set() if apart else self.against(tag, attrs)
        self.doubted |= bool(names)
        if names and self.free is not None and self.count not in self.free:
            apart = True
        self.stack.append((tag, apart, self.container, self.suspect))
        if names and self.free is None:
            self.threads.append(bool(names & THREADS) or self.suspect >= 0 and self.threads[self.suspect])
            self.numbers.append(self.count)
            self.suspects.append(self.suspect)
            self.suspect = len(self.suspects) - 1
        if tag in ("article", "main") and not self.shut:
            self.anchors.append(self.suspect)
        self.open[tag] += 1
        self.shut += apart
        if tag in CONTAINER:
            self.containers.append(self.container)
            self.kinds.append(tag)
            self.container = len(self.kinds) - 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash means nothing for elements that have an end tag

    def close_to(self, tag: str) -> None:
        while self.stack:
            top, apart, container, suspect = self.stack.pop()
            if top in BLOCK:
                self.flush(top)
            self.open[top] -= 1
            self.shut -= apart
            self.container, self.suspect = container, suspect
            if top == tag:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if self.open[tag]:
            self.close_to(tag)

    def handle_data(self, data: str) -> None:
        if not self.shut:
            self.buffer.append(data)

    def close(self) -> None:
        super().close()
        self.flush()


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge"), kernel / kernel.sum(), "valid")


def dense(blocks: list[Block], sigma: float, strictness: float) -> np.ndarray:
    level = smoothed(np.array([len(b.text) / max(1, b.tags) for b in blocks]), sigma)
    return level >= strictness * level.mean()


def folded(own: list[int], parents: list[int]) -> list[int]:
    """Sums over each element and all inside it; elements come after their parents."""
    out = own[:]
    for k in range(len(parents) - 1, -1, -1):
        if parents[k] >= 0:
            out[parents[k]] += out[k]
    return out


def parsed(html: str, free: frozenset[int] | None = None) -> Blocks:
    page = Blocks(free)
    try:
        page.feed(html)
        page.close()
    except AssertionError:  # a marked section of a kind that the parser does not know
        page = Blocks(free)
        page.feed(re.sub(r"<!\[", "<! [", html))
        page.close()
    return page


def released(page: Blocks, sigma: float, strictness: float) -> frozenset[int]:
    """Numbers of the suspects of a page (parsed with all of them) that are read as usual."""
    quiet = lambda k: k < 0 or not page.threads[k]
    left = [b for b in page.blocks if quiet(b.suspect)]
    if not left:
        return frozenset()
    anchors = [k for k in page.anchors if quiet(k)]
    holders: set[int] = set()
    marked = any(k < 0 for k in anchors)  # an article stands free of suspects: none of them can be around it
    if all(k >= 0 for k in anchors):
        for k in anchors:
            while k >= 0 and k not in holders:
                holders.add(k)
                k = page.suspects[k]
    own, total, outside = [0] * len(page.suspects), 0, 0
    for b, chosen in zip(left, dense(left, sigma, strictness), strict=True):
        if chosen:
            total += len(b.text)
            if b.suspect >= 0:
                own[b.suspect] += len(b.text)
            else:
                outside += len(b.text)
    held = folded(own, page.suspects)
    return frozenset(page.numbers[k] for k, n in enumerate(held) if n and (k in holders and n > outside or n > total / 2 and not marked))


def main_text(html: str | None, sigma: float = 1.0, strictness: float = 0.6) -> str:
    """Blocks of the article, joined by line ends; ``strictness``: share of the mean smoothed ratio that a cluster has to exceed."""
    if not html:
        return ""
    page = parsed(html)
    if page.doubted:
        page = parsed(html, released(page, sigma, strictness))
    blocks = page.blocks
    if not blocks:
        return ""
    content = dense(blocks, sigma, strictness)
    own, total = [0] * len(page.kinds), 0
    for b, chosen in zip(blocks, content, strict=True):
        if chosen:
            total += len(b.text)
            if b.container >= 0:
                own[b.container] += len(b.text)
    held = folded(own, page.containers)
    # Of the elements that hold enough of the clusters the last to open is the innermost.
    named = [k for k, n in enumerate(held) if page.kinds[k] in ("article", "main") and 2 * n >= total]
    best = max(named, default=None) if named else max((k for k, n in enumerate(held) if n >= 0.8 * total), default=None)
    if best is not None and page.kinds[best] not in ("body", "html"):
        within = [False] * len(held)
        for k, parent in enumerate(page.containers):
            within[k] = k == best or parent >= 0 and within[parent]
        keep = [b.container >= 0 and within[b.container] for b in blocks]
    else:  # nothing marks the article: the clusters, what lies between them, and the prose that touches them
        at = np.flatnonzero(content)
        first, last = int(at[0]), int(at[-1])
        while first and blocks[first - 1].element in PROSE:
            first -= 1
        while last + 1 < len(blocks) and blocks[last + 1].element in PROSE:
            last += 1
        keep = [first <= k <= last for k in range(len(blocks))]
    return "\n".join(b.text for b, kept in zip(blocks, keep, strict=True) if kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` of every row."""
    ship(pages.sparkSession)
    rows = keyed(pages, id_col, url_col, "url", html_col, "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, url string, text string, n_chars bigint")
