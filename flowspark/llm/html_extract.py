"""Main text of web pages by tree scoring.

A page becomes a tree of elements.  Paragraph-like blocks earn points for length and commas and
pass them to their ancestors (all to the parent, half to the grandparent, a third to the next and
so on); a container's points are discounted by its share of text within links.  The best
container is kept, with siblings that score at least a fifth of it or are paragraphs of prose.
Elements that never hold article text (scripts, styles, menus, forms, headers, footers, side bars,
and boxes with a class token or id that names an advert, notice, comment list, share bar and the like) are cut out
before scoring, so they neither score nor appear.  A token names such a box by its first or last word (``ad-slot``,
``cookie-banner``); ``has-sidebar`` or ``sidebar-layout`` names none.  A cut is taken back, unless it is of comments
or of what is never shown, where the element holds an ``article`` or ``main``, or nearly all of the page's prose: such an element is
the page, not a box on it.

The text of the kept elements is whole: one line for each block, in page order, white space
inside a block turned into one space, character references decoded.

One page at a time in Arrow batches; work and memory are in proportion to the page, however broken it is: every
``<`` is looked at once, and what a tag closes is found by the open elements of each name, not by a walk.

Defined cases: null or empty html gives the empty text; unclosed and stray tags are repaired as
browsers do for blocks; a page without prose gives whatever text its body has outside the cut
elements; repeated rows repeat; a column named like the result is replaced, all others stay, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import numbered

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe template noframes".split())
CUT = frozenset("script style noscript template iframe head nav header footer aside form button select input textarea dialog menu svg canvas object embed audio video noframes title".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
PROSE = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 div section article".split())
CLOSES_P = BLOCK - {"html", "body", "tbody", "td", "tfoot", "th", "thead", "tr", "caption"}
CLOSED_BY_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
GROUPS = ("tbody", "tfoot", "thead")
CLOSED_IN_TABLE = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), **dict.fromkeys(GROUPS, (*GROUPS, "tr", "td", "th"))}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("table ul ol dl body html article section main div".split())

TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9:-]*")
QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
#: Quotes of a tag are paired within so many characters; beyond, its first > ends it.
TAG_CHARS = 65_536
NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|aria-modal)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
# Words that name boxes, words that say what an element has rather than is, and words for the frames of a page.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
BOXES = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising adbox sponsor sponsors sponsored promo promos promotion banner cookie cookies consent gdpr notice alert popup modal overlay subscribe newsletter signup login "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar side widget widgets related recommended recommendations share sharing social toolbar footer masthead topbar header skip tags metalinks".split()
)
HAVING = frozenset("has have no not with without is hide show enable enabled disable disabled".split())
FRAMES = frozenset("layout page content main wrapper wrap container body site template theme grid article".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Cuts: of what is never shown, of comments, and of boxes that prose may take back.
NEVER, TALK, BOX = 1, 2, 3
#: Characters of prose that a notice or advert hardly holds.
MOST_NOTICE = 400
HARD = frozenset("script style noscript template iframe head nav button select input textarea svg canvas object embed audio video noframes title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
SPACE = re.compile(r"[\s ]+")


class Node:
    __slots__ = ("name", "parent", "children", "score", "length", "linked", "whole", "cut", "depth", "block", "held", "main")

    def __init__(self, name: str, parent: Node | None, cut: int = 0):
        self.name, self.parent, self.children, self.cut = name, parent, [], cut
        self.score, self.length, self.linked, self.whole, self.main = 0.0, 0, 0, 0, name in ("article", "main")
        self.depth = parent.depth + 1 if parent else 0
        # the nearest block at or above, and the nearest cut element below it
        edge = name in BLOCK or (cut and name in CUT) or parent is None
        self.block = self if edge else parent.block
        self.held = self if cut and not edge else None if edge or parent is None else parent.held


def box_of(value: str) -> int:
    """Whether a class or id names a box."""
    for token in value.split():
        words = [w.lower() for w in WORD.findall(token)]
        if not words or HAVING & set(words) or words[-1] in FRAMES:
            continue
        ends = {words[0], words[-1]}
        if "meta" in words and "links" in words:
            ends.add("metalinks")
        if ends & BOXES:
            return TALK if ends & COMMENTS else BOX
    return 0


def cut_of(name: str, attributes: str) -> int:
    """The kind of cut that an element's name and attributes ask for."""
    cut = NEVER if name in HARD else BOX if name in CUT else 0
    if cut == NEVER or not attributes or attributes.isspace() or name in ("html", "body", "article", "main"):
        return cut
    for m in NAMED.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return NEVER
        if key in ("class", "id"):
            found = box_of(value)
            cut = TALK if TALK in (found, cut) else found or cut
        if key == "aria-modal" and value.lower() == "true" or key == "role" and value.lower() in ROLES:
            cut = cut or BOX
    return cut


class Tags:
    """The markup of a page from left to right: (start, end, closing, name, attributes); name "" for what is no element."""

    def __init__(self, page: str):
        self.page, self.first, self.bad = page, 0, 0  # first > at or after a place asked for last; no pairs of quotes before

    def _end(self, at: int) -> int:
        if self.first < at:
            self.first = self.page.find(">", at)
        e = self.first
        if e < 0:
            self.first = 1 << 62
        if e < 0 or e == 1 << 62:
            return -1
        if at < self.bad or '"' not in (part := self.page[at:e]) and "'" not in part:
            return e
        m = QUOTED.match(self.page, at, at + TAG_CHARS)
        if not m:
            self.bad = at + TAG_CHARS
        return m.end() - 1 if m else e

    def after(self, where: int):
        page = self.page
        while (at := page.find("<", where)) >= 0:
            two = page[at + 1 : at + 2]
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(page), False, "", ""
            if two in ("!", "?"):
                end = self._end(at + 2)
                if end < 0:
                    return None
                return at, page.find(">", at) + 1, False, "", ""
            m = TAG.match(page, at)
            if m:
                end = self._end(m.end())
                if end < 0:
                    return None
                closing = two == "/"
                return at, end + 1, closing, page[at + 1 + closing : m.end()].lower(), page[m.end() : end]
            where = at + 1
        return None


def parse(page: str) -> Node:
    """The tree; cut elements are marked, and parsed as any other, so that the same tags close them."""
    root = at = Node("html", None)
    opened: dict[str, list[Node]] = {"html": [root]}
    scopes, cut_blocks, cut_tags = [root], [], []  # open elements that stop the search for what a tag closes

    def deepest(nodes: list[Node] | None) -> int:
        return nodes[-1].depth if nodes else -1

    def close(node: Node) -> Node:
        """Leave ``node`` and all within it."""
        here = at
        while True:
            opened[here.name].pop()
            for stack in (scopes, cut_blocks, cut_tags):
                if stack and stack[-1] is here:
                    stack.pop()
            if here is node:
                return node.parent
            here = here.parent

    tags, where, end = Tags(page), 0, len(page)
    while where < end:
        tag = tags.after(where)
        text = page[where : tag[0] if tag else end]
        if text:
            at.children.append(entities.unescape(text))
        if not tag:
            break
        _, where, closing, name, attributes = tag
        if not name:
            continue
        if not closing and name in RAW:  # its content is no markup
            stop = re.compile(rf"</{name}\s*>", re.I).search(page, where)
            where = stop.end() if stop else end
            continue
        mine = opened.get(name)
        if closing:
            if mine and mine[-1].parent is not None:
                stop = -1
                if name not in BLOCK and name not in CUT:
                    stop = max(deepest(scopes), deepest(cut_blocks))
                elif name == "p":
                    stop = deepest(cut_tags)
                if mine[-1].depth > stop:
                    at = close(mine[-1])
            continue
        if name in ("html", "body"):
            continue
        if name in CLOSES_P:  # a block ends an open paragraph, and the inline elements left open in it
            node, held = at.block, at.held
            if node.name == "p":
                at = close(node)
            elif node is not at and name == "p":
                child = at
                if held:
                    while child is not held:
                        child = child.parent
                    while at is not child:
                        at = close(at)
                else:
                    while at is not node:
                        at = close(at)
            if name in HEADINGS and at.name in HEADINGS:
                at = close(at)
        if name in CLOSED_BY_OWN:
            nodes = [opened[n][-1] for n in CLOSED_BY_OWN[name] if opened.get(n)]
            last = max(nodes, key=lambda n: n.depth, default=None)
            if last is not None and last.depth > max(deepest(scopes), deepest(cut_tags)):
                at = close(last)
        if name in CLOSED_IN_TABLE:  # the outermost of what it ends within the nearest table
            table, outer = deepest(opened.get("table")), None
            for n in CLOSED_IN_TABLE[name]:
                some = opened.get(n) or []
                k = bisect_right(some, table, key=lambda x: x.depth)
                if k < len(some) and (outer is None or some[k].depth < outer.depth):
                    outer = some[k]
            if outer is not None:
                at = close(outer)
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            if name in ("br", "hr"):
                at.children.append("\n" if name == "br" else Node("hr", at))
            continue
        at = Node(name, at, cut_of(name, attributes))
        at.parent.children.append(at)
        opened.setdefault(name, []).append(at)
        if name in SCOPE:
            scopes.append(at)
        if at.cut and name in BLOCK:
            cut_blocks.append(at)
        if at.cut and name in CUT:
            cut_tags.append(at)
    return root


def in_order(root: Node) -> list[Node]:
    """All nodes, parents first, in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return order


def measure(order: list[Node], cuts: bool = False) -> None:
    """Lengths of text and linked text in every node, and points, to which cut nodes add nothing; the whole prose of every
    node, boxes within it included."""
    for node in order:
        node.score, node.length, node.linked, node.whole = 0.0, 0, 0, 0
    for node in reversed(order):
        own = " ".join(c for c in node.children if isinstance(c, str))
        size = len(SPACE.sub(" ", own).strip())
        node.length += size
        if node.name == "a":
            node.linked = node.length
        inline = [c for c in node.children if isinstance(c, Node) and c.name not in BLOCK and not c.cut]
        prose = size + sum(c.length for c in inline)
        if node.name in PROSE and prose - sum(c.linked for c in inline) >= 25:
            node.whole += prose
        if node.parent is not None:
            if cuts and node.main:
                node.parent.main = True
            if node.cut in (0, BOX):
                node.parent.whole += node.whole
            if not node.cut:
                node.parent.length += node.length
                node.parent.linked += node.linked
        if node.name in PROSE and prose >= 25:
            commas = own.count(",") + own.count("、") + own.count("，")
            points, up, share = 1 + commas + min(prose / 100, 3), node, 1.0
            for depth in range(1, 6):
                if up.cut or up.parent is None:
                    break
                up = up.parent
                up.score += points * share
                share = 1 / (depth + 1)
    for node in order:
        node.score *= 1 - (node.linked / node.length if node.length else 0)


def take_back(root: Node) -> list[Node]:
    """Undo cuts of what is the page itself; the nodes that are left, parents first."""
    order = in_order(root)
    if any(n.cut for n in order):
        measure(order, cuts=True)
        # the rule of prose is for pages that show no article elsewhere, and for boxes of more than a notice
        shown = any(n.name in ("article", "main") and n.length for n in order)
        back = [n for n in order if n.cut == BOX and (n.main or not shown and n.whole >= MOST_NOTICE and n.whole > 4 * (root.whole - n.whole))]
        for n in back:
            n.cut = 0
        for n in order:
            n.children = [c for c in n.children if isinstance(c, str) or not c.cut]
        order = in_order(root)
    measure(order)
    return order


def blocks(node: Node, out: list[str]) -> None:
    """Texts of the blocks below ``node`` in page order."""
    now: list[str] = []

    def end() -> None:
        line = SPACE.sub(" ", "".join(now)).strip()
        if line:
            out.append(line)
        now.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            now.append(x)
        else:
            inner = list(reversed(x.children))
            if x.name in BLOCK:
                end()
                stack.append(None)
            stack.extend(inner)
    end()


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    order = take_back(root)
    top = max((n for n in order if n.name in BLOCK), key=lambda n: (n.score, n.length), default=root)
    if not top.score:
        top = root
    around = top
    while around is not None and around.name not in ("article", "main"):
        around = around.parent
    top = around or top  # an article element around the best container is kept whole
    out: list[str] = []
    if top.parent is None or top.name in ("article", "main"):
        blocks(top, out)
        return "\n".join(out)
    for x in top.parent.children:
        if x is top:
            blocks(x, out)
        elif isinstance(x, Node) and x.length:
            links = x.linked / x.length
            if x.score >= 0.2 * top.score or x.name == "p" and x.length > 80 and links < 0.25 or x.name in ("h1", "h2", "h3") and links < 0.25:
                blocks(x, out)
    return "\n".join(out)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` without ``html_col``, with the main text."""
    work, column, kept = numbered(pages, (html_col, text_col))
    html, shown = column(html_col), [k for k, _ in kept]
    schema = T.StructType([*work.select(*shown).schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 200) for k in range(0, batch.num_rows, 200)):
                texts = pa.array([main_text(x.as_py()) for x in part.column(html)], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in shown), texts], names=[*shown, "text"])

    out = work.select(*shown, html).mapInArrow(run, schema)
    return out.toDF(*(name for _, name in kept), text_col)
