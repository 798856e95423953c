"""Main text of web pages by composite text density (operator 5).

For every node of the page's tree: characters per tag, adjusted by how much
of the text stands in links.  A node's density sum adds the densities of its
children; the subtree with the largest sum holds the article.  The least
density on the way from it up to ``body`` is the threshold: beside that
subtree, blocks hanging off the way that reach the threshold belong to the
article too, and so do headings, whose density is low as they are short.
Where the subtree lies in an ``article`` element, that is the article.
Bare text beside blocks is a block of its own.

Elements that are no article by their meaning (menus, site headers, footers,
asides, forms, scripts, reader comments, ...) leave the tree beforehand, by
element name, role, or a word of their class or id.  Forms, roles and words
only count for elements that aren't the holders of the page's text.

Each page is a row of its own; tasks hold one Arrow batch (bounded by bytes).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed lists.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul".split())
NOT_ARTICLE = frozenset(
    "head script style noscript template iframe object embed svg canvas map audio video nav menu footer aside button "
    "select option input textarea dialog title noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login paywall sidebar aside rail "
    "menu submenu nav navbar navigation breadcrumb breadcrumbs masthead topbar footer comment comments disqus reply replies "
    "respond share sharing social related recommended recommendations pagination pager widget toolbar skip".split())
#: Words that tell what an element holds even as a part of a longer name.
CLEAR_WORDS = frozenset(
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login paywall comment comments "
    "disqus reply replies respond".split())
#: Left out for being a form or for one part of a name; for a whole name, a clear word or a role; for good.
DOUBTED, NAMED, BARRED = 1, 2, 3
#: Characters of text that a page has at most beside an element of an unwanted name that is kept, and their share.
REST_CHARS, REST_SHARE = 200, 0.05
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
KEPT = frozenset("html body main article".split())

_OPENING = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/<>]*)|<[!?/]")
_MARK = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""(?:^|[\s/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_BLANK = re.compile(r"\s+")
# An open element of the key is closed by a start tag of the values; a scope stops the search.
_CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}),
           "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
_CLOSES = {k: (frozenset(v.split()), s) for k, (v, s) in _CLOSES.items()}
_SCOPE = frozenset("html body table td th button object article section div nav aside footer header main form ul ol li blockquote".split())


class Node:
    __slots__ = ("tag", "drop", "above", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "full", "plain",
                 "inside")

    def __init__(self, tag: str, above: Node | None, drop: int = 0):
        self.tag, self.above, self.drop = tag, above, drop
        self.inside = tag in ("article", "main") or above is not None and above.inside
        self.parts: list[Node | str] = []


def _unwanted(tag: str, attributes: str, inside_article: bool) -> int:
    """0, or how sure it is that the element is no article."""
    if tag in NOT_ARTICLE or tag == "header" and not inside_article:
        return BARRED
    if not attributes or tag in KEPT:
        return DOUBTED if tag == "form" else 0
    found = DOUBTED if tag == "form" else 0
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return BARRED
        if name == "role" and value.lower() in ROLES:
            found = max(found, DOUBTED if value.lower() == "form" else NAMED)
        if name in ("class", "id"):
            for one in value.split():
                parts = [p.lower() for p in _NAME_PART.findall(one)]
                told = [p for p in parts if p in WORDS]
                if told:
                    whole = len(told) == sum(not p.isdigit() for p in parts) or not CLEAR_WORDS.isdisjoint(told)
                    found = max(found, NAMED if whole else DOUBTED)
    return found


def _tag_ends(html: str) -> tuple[list[int], list[int]]:
    """The places of >, " and ', and for each where a tag that is outside quotes there ends (-1: nowhere).

    Told backwards in one pass, as each outcome is that of the mark after the closing quote; so
    a page costs the same however many of its tags have no end.
    """
    marks = [m.start() for m in _MARK.finditer(html)]
    ends, after = [-1] * (len(marks) + 1), {}
    for i in range(len(marks) - 1, -1, -1):
        c = html[marks[i]]
        if c == ">":
            ends[i] = marks[i] + 1
        else:
            ends[i] = ends[after[c] + 1] if c in after else -1
            after[c] = i
    return marks, ends


def parse(html: str) -> Node:
    """The tree of a page.  Open elements are closed as browsers do in the common cases: a block ends a
    paragraph, an item ends the item before it, an end tag ends what is still open inside its element.
    What looks like a tag and has no end is text."""
    root = here = Node("html", None)
    at = text_from = 0
    n, last = len(html), html.rfind(">")
    marks, ends = _tag_ends(html)

    def next_end(start: int) -> int:
        return html.find(">", start) + 1 if start <= last else -1

    while True:
        m = _OPENING.search(html, at)
        if not m:
            if n > text_from:
                here.parts.append(html[text_from:])
            break
        at, tag = m.end(), m[2]
        if tag:
            stop = ends[bisect_left(marks, at)]
            if stop < 0 and m[1]:
                tag, stop = None, next_end(at)
        elif m[0] == "<!--":
            stop = html.find("-->", at) + 3
            stop = stop if stop > 2 else n
        else:
            stop = next_end(at)
        if stop < 0:
            continue
        if m.start() > text_from:
            here.parts.append(html[text_from:m.start()])
        attributes, at, text_from = html[at:stop - 1], stop, stop
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:  # an end tag
            node = here
            while node is not None and node.tag != tag:
                node = None if node.tag in _SCOPE and tag not in BLOCKS else node.above
            if node is not None and node is not root and tag not in ("html", "body"):
                here = node.above
            continue
        if tag in ("html", "body") and tag != "body":
            continue
        if tag in BLOCKS and tag != "body":
            node = here  # an open paragraph ends here
            while node is not None and node.tag not in _SCOPE:
                if node.tag == "p":
                    here = node.above
                    break
                node = node.above
            if tag in _CLOSES:
                closed, scope = _CLOSES[tag]
                node, last = here, None
                while node is not None and node.tag not in scope:
                    if node.tag in closed:
                        last = node
                    node = node.above
                if last is not None:
                    here = last.above
        new = Node(tag, here, _unwanted(tag, attributes, here.inside))
        here.parts.append(new)
        if tag in VOID:
            continue
        if tag in RAW:  # its text holds no tags
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at, last + 1) if at <= last else None
            at = text_from = end.end() if end else n
            continue
        if not attributes.endswith("/"):
            here = new
    return root


def _solid(text: str) -> int:
    return sum(map(len, text.split()))


def _keep_holders(order: list[Node]) -> None:
    """Takes back the drop of elements that hold the page's text outside links: doubted ones that hold most of it, named
    ones that hold most while next to nothing is left beside them.  ``order``: every node before what is in it.

    Where the page has ``article`` or ``main`` elements with text, only what is inside them counts.
    """
    if not any(x.drop in (DOUBTED, NAMED) for x in order):
        return
    for node in reversed(order):
        node.full = node.plain = 0
        if node.drop == BARRED or node.tag == "a":
            continue
        for p in node.parts:
            if isinstance(p, str):
                n = _solid(p)
                node.full += n
                node.plain += n
            else:
                node.full += p.full
                node.plain += p.plain if p.drop != NAMED else 0
    scopes, stack = [], [order[0]]
    while stack:
        node = stack.pop()
        if node.tag in ("article", "main") and node.full:
            scopes.append(node)
        elif node.drop != BARRED:
            stack += [p for p in node.parts if isinstance(p, Node)]
    scopes = scopes or order[:1]
    every, most, rest = sum(x.full for x in scopes), sum(x.plain for x in scopes), 0
    named: list[Node] = []

    def walk(stack: list[Node]) -> int:
        """Decides on the doubted elements; the text that stays."""
        kept = 0
        while stack:
            node = stack.pop()
            if node.tag == "a":
                continue
            for p in node.parts:
                if isinstance(p, str):
                    kept += _solid(p)
                    continue
                if p.drop == DOUBTED and 2 * p.plain > most:
                    p.drop = 0
                if not p.drop:
                    stack.append(p)
                elif p.drop == NAMED:
                    named.append(p)
        return kept

    rest = walk(list(scopes))
    for node in named:  # grows by what is inside those kept
        if 2 * node.full > every and rest < REST_CHARS and rest < REST_SHARE * node.full:
            node.drop = 0
            most += node.plain
            rest += walk([node])
    if not rest:  # the names leave nothing of the page
        stack = list(scopes)
        while stack:
            for p in stack.pop().parts:
                if isinstance(p, Node) and p.drop != BARRED:
                    p.drop = 0
                    stack.append(p)


def _prune(root: Node) -> list[Node]:
    """Drops unwanted subtrees (unless they hold an article or the page's text); the other nodes, each before what is in it."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [p for p in node.parts if isinstance(p, Node)]
    holds = {id(root)}
    for node in reversed(order):
        if node.tag in ("article", "main") or id(node) in holds:
            node.drop = 0 if node.tag not in NOT_ARTICLE else node.drop
            if node.above is not None:
                holds.add(id(node.above))
    _keep_holders(order)
    kept, stack = [], [root]
    while stack:
        node = stack.pop()
        node.parts = [p for p in node.parts if isinstance(p, str) or not p.drop]
        kept.append(node)
        stack += [p for p in node.parts if isinstance(p, Node)]
    return _wrap_runs(kept)


def _wrap_runs(nodes: list[Node]) -> list[Node]:
    """Makes each run of bare text and inline elements beside blocks a node without a tag."""
    blocks: set[int] = set()  # blocks, and inline elements around blocks
    for node in reversed(nodes):
        if node.above is not None and (node.tag in BLOCKS or id(node) in blocks):
            blocks.add(id(node))
            blocks.add(id(node.above))
    out = []
    for node in nodes:
        out.append(node)
        if not any(isinstance(p, Node) and id(p) in blocks for p in node.parts):
            continue
        parts, run = [], None
        for p in node.parts:
            if isinstance(p, Node) and id(p) in blocks:
                parts.append(p)
                run = None
                continue
            if run is None:
                run = Node("", node)
                parts.append(run)
            run.parts.append(p)
            if isinstance(p, Node):
                p.above = run
        node.parts = []
        for p in parts:  # white space alone stays as it is
            if isinstance(p, Node) and not p.tag and not any(isinstance(x, Node) or not x.isspace() for x in p.parts):
                node.parts += p.parts
            else:
                node.parts.append(p)
                if isinstance(p, Node) and not p.tag:
                    out.append(p)
    return out


def _measure(nodes: list[Node]) -> None:
    """Density and density sum of every node."""
    for node in reversed(nodes):
        node.chars = node.link_chars = 0
        node.tags = node.link_tags = 0
        for p in node.parts:
            if isinstance(p, str):
                node.chars += len(p) - p.count(" ") - p.count("\n")
            else:
                node.chars += p.chars
                node.tags += p.tags + (p.tag != "")
                node.link_chars += p.link_chars
                node.link_tags += p.link_tags + (p.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = nodes[0]
    share = body.link_chars / max(1, body.chars)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if c:
            base = log(log(c / max(1, c - node.link_chars) * lc + share * c + e))
            node.density = c / t * max(0.0, log(c / lc * t / lt)) / max(base, 1e-6)
        else:
            node.density = 0.0
        node.total = sum(p.density for p in node.parts if isinstance(p, Node))


def _text(nodes: list[Node]) -> str:
    """The blocks of the subtrees, white space inside a block as one blank, one line each."""
    lines, run = [], []

    def end() -> None:
        if run:
            text = _BLANK.sub(" ", unescape("".join(run))).strip()
            if text:
                lines.append(text)
            run.clear()

    stack: list[Node | str | None] = list(reversed(nodes))
    while stack:
        p = stack.pop()
        if p is None:
            end()
        elif isinstance(p, str):
            run.append(p)
        elif p.tag == "br":
            run.append(" ")
        elif p.tag in BLOCKS or not p.tag:
            end()
            stack.append(None)
            stack += reversed(p.parts)
        else:
            stack += reversed(p.parts)
    end()
    return "\n".join(lines)


def main_text(html: str | None) -> str:
    """The article of a page; empty for a page without text."""
    if not html:
        return ""
    nodes = _prune(parse(html))
    _measure(nodes)
    # Subtrees to choose from hold blocks; a paragraph alone is none.  Of equal sums the outermost.
    holders = [x for x in nodes if any(isinstance(p, Node) and p.tag in BLOCKS for p in x.parts)]
    best = max(holders, key=lambda x: x.total, default=nodes[0])
    node = best
    while node is not None:  # a part of an article element stands for all of it
        best, node = (node if node.tag == "article" else best), node.above
    if not best.chars:
        return _text([nodes[0]])
    way, node = [best], best
    while node.above is not None and node.tag != "body":
        node = node.above
        way.append(node)
    threshold = min(x.density for x in way)
    # beside the subtree: what hangs off the way, in page order
    before: list[Node] = []
    after: list[Node] = []
    for inner, outer in zip(way, way[1:]):
        side = []
        for p in outer.parts:
            if p is inner:
                before, side = side + before, []
            elif isinstance(p, Node) and p.chars and p.link_chars * 2 <= p.chars and (
                    p.density >= threshold or p.tag in HEADINGS):
                side.append(p)
        after += side
    chosen = [*before, best, *after]
    return _text(chosen)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of every row of ``pages``.

    Null and empty html give an empty text, null ids and urls stay null, equal
    rows give equal rows, an empty table an empty one.  Pages are cut nowhere, and other
    columns are ignored.
    """
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html")).mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
