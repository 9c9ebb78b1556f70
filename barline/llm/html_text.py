"""Main text of web pages from flat text blocks and a decision tree.

A page becomes a list of text blocks with word count and link density, those of the blocks before
and after, and where the block stands.  A small decision tree, fitted to the labelled table below
when the operator is built, decides which blocks are the article.

Cases: a NULL or empty page gives an empty text; a page without markup is one block; unclosed and
stray tags are tolerated (only raw text such as a script left open reaches to the page's end); scripts, styles, comments and hidden parts never make blocks; character
references are decoded within each piece of text (never across a tag), white space (no-break spaces too) inside a block becomes one space, and empty
blocks vanish; repeated rows are extracted again; other columns are ignored; long pages are read whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barline.llm.text import pieces

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.DOTALL
)
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

#: Elements whose content is never text, and those that end a block (fixed values).
SILENT = frozenset("script style noscript template svg math iframe object canvas select textarea button title audio video".split())
#: Those of them whose content a parser reads as raw text: without an end tag they reach to the page's end.
RAW = frozenset("script style noscript iframe textarea title".split())
BREAKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li "
    "main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE_SPACE = frozenset({"br", "img", "input", "wbr"})
#: Containers that hold page furniture, by element, by role and by words of class or id (fixed values).
FURNITURE = frozenset("nav footer aside form dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertisements sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments commentlist reply replies respond disqus "
    "discussion share sharing social related recommended recommendations widget pagination pager login search toolbar skip print".split()
)
#: Hints at controls and lists of links, which may also stand on a wrapper or a part of an article, and elements likewise.
SOFT = frozenset("print skip toolbar share sharing social related recommended side rail login search header masthead topbar navigation nav navbar menu".split())
SOFT_TAGS = frozenset({"form", "fieldset"})
PART_WORDS, PART_LINKS = 40, 0.1
#: Elements that an opening tag ends, and the containers beyond which it does not look (fixed values).
_CELLS, _ROWS, _TABLE = frozenset({"td", "th"}), frozenset({"td", "th", "tr"}), frozenset({"table"})
ENDED_BY = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dd": (frozenset({"dd", "dt"}), frozenset({"dl"})),
    "dt": (frozenset({"dd", "dt"}), frozenset({"dl"})),
    "td": (_CELLS, _TABLE | {"tr"}),
    "th": (_CELLS, _TABLE | {"tr"}),
    "tr": (_ROWS, _TABLE | {"tbody", "thead", "tfoot"}),
    "tbody": (_ROWS | {"tbody", "thead", "tfoot"}, _TABLE),
    "thead": (_ROWS | {"tbody", "thead", "tfoot"}, _TABLE),
    "tfoot": (_ROWS | {"tbody", "thead", "tfoot"}, _TABLE),
}
#: Page frames whose own class or id says what else is on the page, and first and last pieces of names that do so.
FRAMES = frozenset({"html", "body", "main", "article"})
BEFORE, AFTER = frozenset("has no with without".split()), frozenset("open closed".split())
CONTENT = frozenset({"article", "main"})
CONTENT_HINTS = frozenset("article content post entry story main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "content", "page_content", "heading")
#: The labelled table (fixed values).  Neighbours, as words and link density before and after:
NEIGHBOURS = {
    "any": ((0, 0.0, 0, 0.0), (60, 0.0, 60, 0.0), (3, 1.0, 50, 0.0), (50, 0.0, 3, 1.0), (2, 1.0, 2, 1.0), (12, 0.0, 12, 0.0), (0, 0.0, 80, 0.0), (80, 0.0, 0, 0.0)),
    "text": ((60, 0.0, 60, 0.0), (25, 0.0, 90, 0.1), (110, 0.0, 30, 0.0), (18, 0.1, 22, 0.0)),
    "links": ((2, 1.0, 2, 1.0), (1, 1.0, 3, 0.9), (0, 0.0, 2, 1.0), (4, 0.8, 0, 0.0)),
}
#: Words, link density, furniture, content, page with content, heading, neighbours, and whether it is article text.
LABELLED = (
    *((words, links, 0, 1, 1, heading, "any", 1) for words in (1, 4, 9, 25, 80, 300) for links in (0.0, 0.1, 0.5) for heading in (0, 1)),
    (2, 1.0, 0, 1, 1, 1, "any", 1), (9, 1.0, 0, 1, 1, 1, "any", 1), (3, 1.0, 0, 1, 1, 0, "any", 0), (8, 0.95, 0, 1, 1, 0, "any", 0),
    *((words, links, 1, content, page, heading, "any", 0) for words in (1, 6, 20, 90) for links in (0.0, 1.0) for content, page in ((0, 0), (0, 1), (1, 1)) for heading in (0, 1)),
    *((words, links, 0, 0, 1, heading, "any", 0) for words in (1, 6, 20, 90) for links in (0.0, 1.0) for heading in (0, 1)),
    *((words, links, 0, 0, 0, 0, "any", 1) for words in (12, 25, 80, 300) for links in (0.0, 0.1)),
    *((words, 1.0, 0, 0, 0, 0, "any", 0) for words in (1, 4, 12, 30)),
    *((words, 0.0, 0, 0, 0, heading, "text", 1) for words in (1, 4, 8) for heading in (0, 1)),
    *((words, 0.0, 0, 0, 0, heading, "links", 0) for words in (1, 4, 8) for heading in (0, 1)),
)


@dataclass
class Node:
    keep: bool
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def decide(self, row: tuple) -> bool:
        node = self
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.limit else node.high
        return node.keep


def grow(x: np.ndarray, y: np.ndarray, least: int = 1, depth: int = 9) -> Node:
    """Binary tree by Gini impurity; of equal cuts the first feature and the lowest limit win."""
    node = Node(keep=bool(2 * y.sum() >= len(y)))
    if depth == 0 or y.min() == y.max():
        return node
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            below = x[:, f] <= limit
            if min(below.sum(), (~below).sum()) < least:
                continue
            impurity = sum(part.sum() * y[part].mean() * (1 - y[part].mean()) for part in (below, ~below))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(limit))
    if best is not None:
        _, node.feature, node.limit = best
        below = x[:, node.feature] <= node.limit
        node.low, node.high = grow(x[below], y[below], least, depth - 1), grow(x[~below], y[~below], least, depth - 1)
    return node


def fitted(table: tuple = LABELLED) -> Node:
    rows = np.array(
        [(words, links, *near, furniture, content, page, heading, label) for words, links, furniture, content, page, heading, kind, label in table for near in NEIGHBOURS[kind]], dtype=float
    )
    return grow(rows[:, :-1], rows[:, -1].astype(int))


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    furniture: bool = False
    soft: tuple[int, ...] = ()
    content: bool = False
    heading: bool = False


@dataclass
class Place:
    """What an element opens: furniture for certain, furniture by its looks, article content, a hidden part."""

    furniture: bool = False
    soft: bool = False
    part: bool = False
    content: bool = False
    hidden: bool = False

    def tells(self) -> bool:
        return self.furniture or self.soft or self.content or self.hidden


@dataclass
class Open:
    """An open element with all that the elements around it say."""

    tag: str = ""
    furniture: bool = False
    soft: tuple[int, ...] = ()
    content: bool = False
    hidden: bool = False


def _hinting(value: str) -> set[str]:
    """Pieces of the names in a class or id, without names that tell of another part (has-sidebar, comments-open)."""
    names = [[p for p in re.split(r"[^a-z0-9]+", name) if p] for name in value.split()]
    return {p for name in names if name and not (len(name) > 1 and (name[0] in BEFORE or name[-1] in AFTER)) for p in name}


END_OF_UNCLOSED = re.compile(rf"</?(?:{'|'.join(sorted(BREAKS - {'option', 'hr'}))})(?=[\s/>]|\Z)", re.IGNORECASE)


def _pairs(page: str, tag: str) -> dict[int, int]:
    """End of each element ``tag`` that has an end tag, by the place of its opening tag."""
    opened: list[int] = []
    ends = {}
    for match in re.finditer(rf"<(/?){tag}(?=[\s/>]|\Z)(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?:>|\Z)", page, re.IGNORECASE):
        if not match[1]:
            if not match[0].rstrip(">").rstrip().endswith("/"):
                opened.append(match.start())
        elif opened:
            ends[opened.pop()] = match.end()
    return ends


def _place(tag: str, attributes: str, nested: bool = False) -> Place:
    """How an element is judged by its own name and attributes.

    ``part`` tells that the only hints are pieces of longer names (related-work).
    """
    place = Place(furniture=tag in FURNITURE - SOFT_TAGS, soft=tag in SOFT_TAGS, content=tag in CONTENT)
    if attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                found = set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value)))
                hints = _hinting(value) & HINTS if tag not in FRAMES or nested else set()
                if hints <= SOFT:
                    place.part |= bool(hints) and hints.isdisjoint(value.split())
                    place.soft |= bool(hints)
                else:
                    place.furniture = True
                place.content |= tag in ("div", "section") and not found.isdisjoint(CONTENT_HINTS)
            elif name == "role":
                place.furniture |= value in ROLES
                place.content |= value in ("main", "article")
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                place.hidden = True
    place.content &= not place.furniture
    return place


def _implied_ends(stack: list[Open], tag: str) -> None:
    """Take off the elements that an opening ``tag`` ends: a paragraph by any block, items and cells by the next one."""
    for ended, walls in ((frozenset({"p"}), BREAKS - {"p"}), ENDED_BY.get(tag, (frozenset(), BREAKS))):
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in ended:
                del stack[i:]
            elif stack[i].tag in walls:
                break


def blocks_of(page: str) -> tuple[list[Block], list[Place]]:
    """Text blocks in page order, and the elements that are furniture by their looks only."""
    found: list[Block] = []
    block = Block()
    stack: list[Open] = []
    softs: list[Place] = []
    at, links, heading = 0, 0, False
    state = Open()

    def close() -> None:
        nonlocal block
        if block.parts:
            found.append(block)
        block = Block()

    def put(text: str) -> None:
        if text and not state.hidden:
            text = html.unescape(text)
            if not block.parts:
                block.furniture, block.soft, block.content, block.heading = state.furniture, state.soft, state.content, heading
            block.parts.append(text)
            if links:
                block.linked.append(text)

    scan, n = TOKEN.finditer(page), len(page)
    skip_to = 0
    paired: dict[str, dict[int, int]] = {}
    for match in scan:
        if match.start() < skip_to:
            continue
        put(page[at : match.start()])
        at = match.end()
        tag = match[2]
        if tag is None:
            continue
        tag, closing = tag.lower(), match[1] == "/"
        if tag in SILENT and not closing:
            if not match[3].rstrip().endswith("/"):
                if tag in RAW:
                    end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                    at = skip_to = end.end() if end else n
                else:
                    if tag not in paired:
                        paired[tag] = _pairs(page, tag)
                    end = paired[tag].get(match.start())
                    if end is None:  # left open: it ends where the next block begins or ends
                        block_tag = END_OF_UNCLOSED.search(page, at)
                        end = block_tag.start() if block_tag else n
                    at = skip_to = end
            put(" ")
            continue
        if tag in INLINE_SPACE:
            put(" ")
        elif tag == "a":
            links = 0 if closing else 1
        if tag in BREAKS:
            close()
            if tag in HEADINGS:
                heading = not closing
            elif tag == "p":
                heading = False
            if not closing:
                _implied_ends(stack, tag)
                state = stack[-1] if stack else Open()
        if tag in VOID or tag in ("a", "head"):
            continue
        opens = not closing and (tag in BREAKS and tag not in ("p", "li") and tag not in HEADINGS or bool(match[3]) and _place(tag, match[3]).tells())
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
        elif opens and not match[3].rstrip().endswith("/"):
            # an article inside an article may be a reader's comment, so its hints count
            place = _place(tag, match[3], tag == "article" and any(s.tag == tag for s in stack))
            above = stack[-1] if stack else Open()
            # a header inside the article carries its title, elsewhere it is the page's
            furniture = place.furniture or tag == "header" and not above.content
            soft = above.soft
            if place.soft and not furniture:
                place.part &= above.content
                soft = (*soft, len(softs))
                softs.append(place)
            stack.append(Open(tag, above.furniture or furniture, soft, above.content or place.content and not furniture, above.hidden or place.hidden))
        state = stack[-1] if stack else Open()
    put(page[at:])
    close()
    return found, softs


def _plain_words(rows: list[tuple[int, float, Block]]) -> float:
    return sum(words * (1.0 - links) for words, links, _ in rows)


def settle_soft(rows: list[tuple[int, float, Block]], softs: list[Place]) -> None:
    """Mark the blocks of soft elements as furniture, unless what an element holds speaks for an article.  Outer elements go first."""
    inside: list[list[int]] = [[] for _ in softs]
    for i, (_, _, block) in enumerate(rows):
        for number in block.soft:
            inside[number].append(i)
    settled: set[int] = set()
    for number, place in enumerate(softs):
        own = [rows[i] for i in inside[number] if not rows[i][2].furniture]
        if not own:
            continue
        members = set(inside[number])
        free = [r for i, r in enumerate(rows) if i not in members and not r[2].furniture and not r[2].soft]
        body = [r for r in own if r[2].content and settled.issuperset(n for n in r[2].soft if n < number)]
        words, plain = sum(r[0] for r in own), _plain_words(own)
        if place.part and plain >= PART_WORDS and plain >= (1.0 - PART_LINKS) * words:
            settled.add(number)
        elif not place.part and not any(r[2].content for r in free):
            anywhere = any(r[2].content for r in rows)
            if _plain_words(body if anywhere else own) >= max(1.0 if anywhere else PART_WORDS, _plain_words(free)):
                settled.add(number)
    for _, _, block in rows:
        block.furniture |= not settled.issuperset(block.soft)


def main_text(page: str, tree: Node) -> str:
    texts, rows = [], []
    blocks, softs = blocks_of(page)
    for block in blocks:
        text = " ".join("".join(block.parts).split())
        if text:
            words = len(text.split(" "))
            linked = len(" ".join(block.linked).split())
            texts.append(text)
            rows.append((words, min(1.0, linked / words), block))
    if softs:
        settle_soft(rows, softs)
    anywhere = any(b.content and not b.furniture for _, _, b in rows)
    kept = []
    nothing = (0, 0.0, None)
    for i, (words, links, block) in enumerate(rows):
        before, after = rows[i - 1] if i else nothing, rows[i + 1] if i + 1 < len(rows) else nothing
        row = (words, links, before[0], before[1], after[0], after[1], block.furniture, block.content, anywhere, block.heading)
        if tree.decide(row):
            kept.append(texts[i])
    return "\n".join(kept)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    tree = fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            texts = [main_text(p, tree) if p else "" for p in batch.column(2).to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
