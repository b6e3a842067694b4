"""Main text of web pages: a minimum cut between article and boilerplate blocks.

A page is cut into blocks of text at its block-level tags. A small logistic
classifier gives each block the cost of calling it boilerplate and of calling
it article; these are the capacities of its edges to the source and the sink.
Neighbours on the page and blocks that are close in the document tree are tied
by edges whose capacity is the cost of parting them. The minimum cut labels all
blocks at once: a doubtful line between two paragraphs goes with them.
"""

from __future__ import annotations

import functools
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from fluxweave.llm.tables import schema_with, table

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN_TAGS = frozenset("script style head title noscript template svg math iframe object canvas audio video select textarea button datalist".split())
# a start tag that closes an open one of these by itself
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_PARAGRAPH = BLOCK_TAGS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend"}
PARAGRAPH = frozenset(("p",))
BLOCKS_AROUND_PARAGRAPHS = BLOCK_TAGS - PARAGRAPH
HOLDERS = frozenset(("ul", "ol", "dl", "table", "menu", "select"))
BOILER_TAGS = frozenset("nav footer aside form menu dialog search fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_NAME = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|comment\w+|consent|cookies?|copyright|disqus|footer|gdpr|header|masthead|menu|"
    r"modal|nav|navbar|navigation|newsletter|notice|outbrain|pager|pagination|popup|promo\w*|related|replies|respond|share|sharing|sidebar|"
    r"site-?header|social(?=$|\s|[-_](?:bar|buttons?|icons?|links?|media|nav|shar\w*))|sponsor\w*|subscribe|taboola|toolbar|widget)(?:$|[-_ ]|\d)",
    re.I,
)
BOILER_ROLES = frozenset("banner navigation complementary contentinfo search form dialog alert menu menubar toolbar".split())
ARTICLE_NAME = re.compile(r"(?:^|[-_ ])(?:article|articlebody|content|entry|post|story|main|body|text)(?:$|[-_ ])", re.I)

HEADER_WORD = re.compile(r"(?:^|(?<=[-_ ]))header(?=$|[-_ ])", re.I)
COMMENT_NAME = re.compile(r"comment|disqus|repl(?:y|ies)|respond", re.I)

# weights of the classifier's logit for article
BIAS, IN_ARTICLE, ARTICLE_CLASS, IN_BOILER, LINKED, LENGTH, SENTENCE, HEADING, OUTSIDE = -0.6, 3.0, 1.2, -7.0, -4.0, 0.5, 0.6, 0.3, -2.5
NEXT_TO, SAME_PARENT = 0.6, 0.8  # costs of parting neighbours, the second fading with their distance in the tree


@functools.lru_cache(maxsize=1 << 16)
def _told_by(names: str) -> tuple[bool, bool, bool, bool]:
    """Whether class and id speak of an article, of boilerplate, of boilerplate even inside an article (whose header is its own), and of comments."""
    inside = bool(BOILER_NAME.search(HEADER_WORD.sub("", names)))
    return bool(ARTICLE_NAME.search(names)), bool(BOILER_NAME.search(names)), inside, bool(COMMENT_NAME.search(names))


@dataclass(slots=True)
class Node:
    tag: str
    number: int
    boiler: bool
    article: bool
    named: bool
    depth: int
    by_name: bool = False  # boilerplate for nothing but its class or id, and no comments


@dataclass(slots=True)
class Block:
    path: tuple[Node, ...]
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


class PageBlocks(HTMLParser):
    """Collects the blocks of a page, whatever its tags leave open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Node] = []
        self.blocks: list[Block] = []
        self.current: Block | None = None
        self.count = self.unseen = self.links = 0
        self.has_article = self.wrapped = False

    def updatepos(self, i: int, j: int) -> int:
        return j  # lines are not counted

    def _end_block(self) -> None:
        if self.current is not None:
            self.current.text = " ".join("".join(self.current.parts).split())
            if self.current.text:
                self.blocks.append(self.current)
            self.current = None

    def _pop(self, upto: int) -> None:
        while len(self.open) > upto:
            tag = self.open.pop().tag
            self.unseen -= tag in UNSEEN_TAGS
            self.links -= tag == "a"

    def _close_last(self, tags: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].tag in tags:
                self._end_block()
                self._pop(at)
                return
            if self.open[at].tag in stop:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.handle_data(" ")
            return
        if tag == "body":  # the head ends here, even if its end tag is missing
            while self.open and self.open[-1].tag != "html":
                self._pop(len(self.open) - 1)
        if tag in BLOCK_TAGS:
            self._end_block()
            if tag in ENDS_PARAGRAPH:
                self._close_last(PARAGRAPH, BLOCKS_AROUND_PARAGRAPHS)
            if tag in CLOSES:
                self._close_last(CLOSES[tag], HOLDERS)
        if tag in VOID_TAGS:
            return
        article = tag in ("article", "main")
        boiler = tag in BOILER_TAGS or (tag == "header" and not any(n.article for n in self.open))
        named = by_name = False
        if attrs:
            given = dict(attrs)
            names = f"{given.get('class') or ''} {given.get('id') or ''}"
            article = article or given.get("role") in ("main", "article")
            boiler = boiler or given.get("role") in BOILER_ROLES or "hidden" in given or given.get("aria-hidden") == "true"
            if names != " ":
                named, outside, inside, comments = _told_by(names)
                if tag not in ("body", "html", "article", "main") and (inside or (outside and not any(n.article for n in self.open))):
                    by_name = not boiler and not comments
                    boiler = True
        self.count += 1
        self.open.append(Node(tag, self.count, boiler, article, named, len(self.open), by_name))
        if article:
            self.has_article = True
            self.wrapped = self.wrapped or any(n.by_name for n in self.open)
        self.unseen += tag in UNSEEN_TAGS
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS and tag not in ("br",) and tag in ("svg", "math", "object", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self._end_block()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].tag == tag:
                self._pop(at)
                return
            if tag not in BLOCK_TAGS and tag not in UNSEEN_TAGS and self.open[at].tag in BLOCK_TAGS:
                return  # an inline end tag closes nothing beyond its block

    def handle_data(self, data: str) -> None:
        if self.unseen:
            return
        if self.current is None:
            if not data.strip():
                return
            self.current = Block(tuple(self.open))
        self.current.parts.append(data)
        if self.links:
            self.current.linked += len(data.strip())

    def close(self) -> None:
        super().close()
        self._end_block()
        if self.wrapped:
            self._free_wrappers()

    def _free_wrappers(self) -> None:
        """A name of boilerplate says nothing where the element holds most of the page's article, as a layout named for its sidebar does."""
        whole, held, wrappers = 0, {}, {}
        for block in self.blocks:
            inner = max((i for i, n in enumerate(block.path) if n.article), default=-1)
            if inner >= 0:
                size = max(len(block.text) - block.linked, 0)
                whole += size
                for node in block.path[:inner]:
                    if node.by_name:
                        wrappers[node.number] = node
                        held[node.number] = held.get(node.number, 0) + size
        for number, node in wrappers.items():
            node.boiler = node.boiler and 2 * held[number] <= whole


def page_blocks(html: str) -> tuple[list[Block], bool]:
    page = PageBlocks()
    page.feed(html)
    page.close()
    return page.blocks, page.has_article


def article_logit(block: Block, has_article: bool) -> float:
    """Log odds that the block belongs to the article."""
    size = len(block.text)
    last_article = max((i for i, n in enumerate(block.path) if n.article), default=-1)
    out = BIAS + LENGTH * math.log1p(size / 40) + LINKED * min(1.0, block.linked / size)
    if last_article >= 0:
        out += IN_ARTICLE
    elif has_article:
        out += OUTSIDE
    if any(n.named for n in block.path):
        out += ARTICLE_CLASS
    if any(n.boiler for n in block.path):
        out += IN_BOILER
    if block.text[-1] in ".!?…。！？:\"”»":
        out += SENTENCE
    if any(n.tag in HEADINGS for n in block.path):
        out += HEADING
    return out


def _distance(a: Block, b: Block) -> int:
    """Steps in the tree between the elements that hold two blocks."""
    shared = 0
    for x, y in zip(a.path, b.path):
        if x.number != y.number:
            break
        shared += 1
    return len(a.path) + len(b.path) - 2 * shared


def minimum_cut(source: list[float], sink: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut, by shortest augmenting paths.

    ``source`` and ``sink`` are the capacities of each node's two terminal
    edges; a tie has its capacity both ways. What both terminals can give a node
    flows through it at once; only the rest needs paths.
    """
    n = len(source)
    left = [s - t for s, t in zip(source, sink)]  # above 0: still from the source, below: still to the sink
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, capacity in ties:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + capacity
            near[b][a] = near[b].get(a, 0.0) + capacity
    tiny = 1e-9
    while True:
        came: dict[int, int] = {i: -1 for i in range(n) if left[i] > tiny}
        queue, end = deque(came), -1
        while queue and end < 0:
            a = queue.popleft()
            for b, capacity in near[a].items():
                if capacity > tiny and b not in came:
                    came[b] = a
                    if left[b] < -tiny:
                        end = b
                        break
                    queue.append(b)
        if end < 0:
            return [i in came for i in range(n)]
        path = [end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        flow = min(left[path[-1]], -left[end], *(near[a][b] for b, a in zip(path, path[1:])))
        left[path[-1]] -= flow
        left[end] += flow
        for b, a in zip(path, path[1:]):
            near[a][b] -= flow
            near[b][a] += flow


def article_blocks(html: str) -> list[str]:
    """Texts of the blocks on the article's side of the cut, in page order."""
    blocks, has_article = page_blocks(html)
    if not blocks:
        return []
    odds = [max(-20.0, min(20.0, article_logit(b, has_article))) for b in blocks]
    # costs of a wrong label are negative log probabilities
    as_boiler = [math.log1p(math.exp(o)) for o in odds]
    as_article = [math.log1p(math.exp(-o)) for o in odds]
    ties = [(i, i + 1, NEXT_TO / (1 + _distance(a, b) / 2)) for i, (a, b) in enumerate(zip(blocks, blocks[1:]))]
    before: dict[int, int] = {}
    for i, block in enumerate(blocks):
        parent = block.path[-2].number if len(block.path) > 1 else 0
        if parent in before:
            ties.append((before[parent], i, SAME_PARENT / (1 + _distance(blocks[before[parent]], block) / 2)))
        before[parent] = i
    kept = minimum_cut(as_boiler, as_article, ties)
    return [b.text for b, k in zip(blocks, kept) if k]


def main_text(html: str | None) -> str:
    """The article's blocks, one a line; empty for null, empty or text-free pages."""
    return "\n".join(article_blocks(html)) if html else ""


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with ``text`` (main text) and ``n_chars`` (its code points); columns of these names are replaced.

    White space inside a block is one space, blocks are joined by a new line.
    Pages are read whole; the graph of a page has one node for each block.
    """
    rest = [c for c in pages.columns if c not in (text, "n_chars")]
    plain = pages.select(*rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h) for h in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], [*rest, text, "n_chars"]
            )

    return plain.mapInArrow(run, schema_with(plain, **{text: "string", "n_chars": "long"}))


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
