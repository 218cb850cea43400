"""Main text of HTML pages by tree scoring.

A page is read into a tree of block elements. Each paragraph earns points for
its length and its commas, less the share of its characters inside links, and
passes them to its ancestors, halved at each level. The element with the most
points, again less its link share, is the main container; siblings with a fair
part of its points stay with it. Menus, headers, footers, sidebars, notices,
adverts, forms and reader comments are recognised by element, role or class
and earn nothing.

A class or id marks an element as boilerplate for sure only by a whole name
(``sidebar``); a part of a name (``has-sidebar``), and a form, marks one only
if it has less than half of the page's text and no article of its own. An
element with most of the text around an article isn't boilerplate by its class
at all. If nothing is left of a page that has text, classes are disregarded.

Defined cases: null and empty pages give an empty text; a page without any
paragraph is scored by its bare blocks; unclosed and crossing elements are
closed as browsers do for paragraphs and list items, and only script, style,
title, textarea and comments swallow the rest of a page if unclosed; of equal
scores the first element of the page wins; pages of any length and depth are
read whole in linear time; repeated rows give equal rows; an empty table an
empty result; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names and the words that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
RAW = frozenset("script style noscript template textarea title iframe svg math object select".split())
DROPPED = frozenset("nav footer aside form button dialog menu figcaption header fieldset canvas audio video map head".split())
PARAGRAPH = frozenset("p pre blockquote td dd h1 h2 h3 h4 h5 h6 li dt th".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner sponsor sponsored promo promotion sidebar side rail "
    "comment comments commentlist reply replies respond disqus discussion footer foot header masthead nav navbar navigation menu "
    "breadcrumb breadcrumbs cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup "
    "login social share sharing related recommended widget toolbar pagination pager search skip tags copyright".split()
)
#: Elements that close an open element of the second set when they begin.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body html article section main div td th".split())
#: Elements through which an open paragraph, list item or cell is looked for.
CLOSED = PARAGRAPH | frozenset("tr option ul ol dl table".split())
#: Elements that have the rest of a page if they aren't closed.
SWALLOWING = frozenset("script style title textarea".split())

SIBLING_SHARE = 0.2
CHARS_A_POINT, MOST_LENGTH_POINTS = 100, 3
LINK_LIST = 0.6

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+")


class _Node:
    __slots__ = ("article", "chars", "dropped", "link_chars", "links", "mark", "parent", "score", "tag")

    def __init__(self, tag: str, parent: _Node | None, mark: int):
        self.tag, self.parent, self.mark = tag, parent, mark
        self.score, self.chars, self.link_chars, self.links = 0.0, 0, 0, 0
        self.article = tag in ("article", "main") and not mark
        self.dropped = False


#: How sure an element is boilerplate: by a part of a name, by a whole name or an attribute, by its own kind.
_MAYBE, _NAMED, _SURE = 1, 2, 3


def _mark(attributes: str) -> int:
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return 0
    found = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            if not MARKS.isdisjoint(value.split()):
                found = max(found, _NAMED)
            elif not MARKS.isdisjoint(_SPLIT.split(value)):
                found = max(found, _MAYBE)
        elif name == "role":
            if value in ROLES:
                return _SURE
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return _SURE
        elif name == "hidden" or value == "true":
            return _SURE
    return found


def _tree(page: str) -> tuple[list[_Node], list[tuple[_Node, str]]]:
    """All elements, parents before children, and the blocks of text in page order with the element that holds each."""
    root = _Node("html", None, 0)
    nodes, node, blocks, texts = [root], root, [], []
    link_depth, link_chars = 0, 0
    open_tags: dict[str, int] = {}

    def flush() -> None:
        nonlocal link_chars
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                blocks.append((node, text))
                node.chars += len(text)
                node.link_chars += min(link_chars, len(text))
            texts.clear()
        link_chars = 0

    def add(text: str) -> None:
        nonlocal link_chars
        if text:
            text = html.unescape(text) if "&" in text else text
            texts.append(text)
            if link_depth:
                link_chars += len(" ".join(text.split()))

    def leave() -> None:
        nonlocal node
        open_tags[node.tag] -= 1
        node = node.parent

    pos, end = 0, len(page)
    unclosed: set[str] = set()
    while pos < end:
        m = _TOKEN.search(page, pos)
        if m is None:
            add(page[pos:])
            break
        if m.start() > pos:
            add(page[pos : m.start()])
        pos = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if closing:
            if name == "a":
                link_depth = max(0, link_depth - 1)
            if name in INLINE or name in VOID:
                if name == "br":
                    flush()
                continue
            flush()
            if open_tags.get(name):
                while node.tag != name:
                    leave()
                leave()
                link_depth = 0
            continue
        if name in RAW:
            swallows = name in SWALLOWING
            if (swallows or not attributes.rstrip().endswith("/")) and name not in unclosed:
                shut = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, pos)
                if shut is not None:
                    pos = page.find(">", shut.start()) + 1 or end
                elif swallows:
                    pos = end
                else:
                    unclosed.add(name)  # nor is any later one
            if name not in ("script", "style"):
                texts.append(" ") if texts else None
            continue
        if name == "a":
            link_depth += 1
            node.links += 1
        if name in INLINE:
            continue
        if name in ("br", "hr"):
            flush()
            continue
        if name in VOID:
            continue
        flush()
        if name == "body" or name == "html":
            continue
        closes = CLOSES.get(name, ())
        at = node
        while at is not root and at.tag in CLOSED:
            if at.tag == "p" or at.tag in closes:
                while node is not at:
                    leave()
                leave()
                break
            if at.tag in SCOPE:
                break
            at = at.parent
        own = _mark(attributes)
        if name in DROPPED and not (name in ("header", "figcaption") and (open_tags.get("article") or open_tags.get("main"))):
            own = max(own, _MAYBE) if name == "form" else _SURE
        node = _Node(name, node, own)
        nodes.append(node)
        open_tags[name] = open_tags.get(name, 0) + 1
        link_depth = 0
    flush()
    return nodes, blocks


def _add_up(nodes: list[_Node]) -> None:
    """Characters, links and articles of each element with all that it holds."""
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
            node.parent.links += node.links
            node.parent.article |= node.article and node.mark < _NAMED


def _drop(nodes: list[_Node], by_name: bool) -> None:
    total = nodes[0].chars
    for node in nodes:
        most = 2 * node.chars >= total
        gone = node.mark == _SURE or by_name and (node.mark == _NAMED and not (most and node.article) or node.mark == _MAYBE and not most and not node.article)
        node.dropped = gone or node.parent is not None and node.parent.dropped


def _without_dropped(nodes: list[_Node], blocks: list[tuple[_Node, str]]) -> None:
    """Characters and links again, of what is left."""
    links = {}
    for node in nodes:
        links[id(node)] = (node.chars, node.link_chars, node.links) if node.dropped else None
    for node in reversed(nodes):
        if node.dropped and node.parent is not None and not node.parent.dropped:
            at, (chars, link_chars, n) = node.parent, links[id(node)]
            at.chars, at.link_chars, at.links = at.chars - chars, at.link_chars - link_chars, at.links - n
            less = links.get((id(at), "less"), (0, 0, 0))
            links[id(at), "less"] = tuple(a + b for a, b in zip(less, (chars, link_chars, n), strict=True))
        elif not node.dropped and node.parent is not None and (id(node), "less") in links:
            chars, link_chars, n = links[id(node), "less"]
            at = node.parent
            at.chars, at.link_chars, at.links = at.chars - chars, at.link_chars - link_chars, at.links - n
            less = links.get((id(at), "less"), (0, 0, 0))
            links[id(at), "less"] = tuple(a + b for a, b in zip(less, (chars, link_chars, n), strict=True))


def _density(node: _Node) -> float:
    return node.link_chars / node.chars if node.chars > 0 else 0.0


def _best(blocks: list[tuple[_Node, str]]) -> _Node | None:
    scored: dict[int, _Node] = {}
    for node, text in blocks:
        points = (1 + text.count(",") + min(len(text) / CHARS_A_POINT, MOST_LENGTH_POINTS)) * (1 - _density(node))
        at = node.parent if node.tag in PARAGRAPH and node.parent is not None else node
        while at is not None and points > 0.01:
            at.score += points
            scored[id(at)] = at
            at, points = at.parent, points / 2
    best, most = None, 0.0
    for node in scored.values():
        value = node.score * (1 - _density(node))
        if value > most:
            best, most = node, value
    return best


def main_text(page: str | None) -> str:
    """Main text of one page: its blocks in page order, joined by one space."""
    if not page:
        return ""
    for by_name in (True, False):
        nodes, every = _tree(page)
        _add_up(nodes)
        _drop(nodes, by_name)
        blocks = [(node, text) for node, text in every if not node.dropped]
        if not blocks and by_name and every:
            continue
        _without_dropped(nodes, blocks)
        return _chosen(nodes, blocks)
    return ""


def _chosen(nodes: list[_Node], blocks: list[tuple[_Node, str]]) -> str:
    best = _best(blocks)
    if best is None:
        return ""
    while best.parent is not None and best.tag in ("ul", "ol", "dl", "tr", "tbody", "table"):
        best = best.parent
    kept = {id(best)}
    if best.parent is not None:
        least = SIBLING_SHARE * best.score
        for other in nodes:
            if other.parent is best.parent and other is not best and not other.dropped and other.chars:
                paragraph = other.tag in PARAGRAPH and other.chars > 80 and _density(other) < 0.25
                if (other.score >= least and _density(other) < 0.5) or paragraph:
                    kept.add(id(other))
    # parents come first, so each element takes over what holds for its parent
    inside: dict[int, bool] = {}
    for node in nodes:
        if id(node) in kept:
            inside[id(node)] = True
        elif node.tag in ("ul", "ol", "table", "dl", "div", "section") and node.links >= 3 and _density(node) > LINK_LIST:
            inside[id(node)] = False
        else:
            inside[id(node)] = node.parent is not None and inside[id(node.parent)]
    return " ".join(text for node, text in blocks if inside[id(node)])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [main_text(page.as_py()) for page in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
