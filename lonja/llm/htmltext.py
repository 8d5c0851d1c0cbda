"""Main text of web pages by composite text density.

A page becomes a small tree. Every node has the characters and tags below it, and those of links; its
composite density is characters per tag, weighed down by the share of link text against the page's.
The node whose children's densities sum highest roots the main text; the smallest density on its path
to the body is the threshold. Every block of the page that reaches it is kept, beside that node too.
Below it, link-heavy blocks go, and bare text outside that node that is no heading, paragraph, list or
table. ``article`` and ``main`` only decide between equal sums.

Before that, hidden elements go, and elements that are no article text by their meaning: scripts, styles,
forms, menus, footers, asides, page headers, and elements of which a whole class name, id or role is
sidebar, comments and so on (``UNWANTED``), but none that holds an article or main or most of the text
(``without_named``).

Text: character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined by an empty line.

Defined cases: null and empty pages give ""; unclosed and misnested tags are closed as far as needed;
text without tags is one block; equal sums prefer the earlier node; repeated rows come as often as they
are; an empty table gives an empty result; other columns are ignored. One pass, no shuffle.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Names of HTML elements by their role in the standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noframes svg math select object canvas audio video".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
 h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption""".split())
DROPPED = frozenset("head nav footer aside form menu button dialog fieldset label option".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = frozenset("table td th ul ol dl body html article section div".split())
#: Whole class names, ids and roles of elements that hold no article text.
UNWANTED = re.compile(r"""ads?|advert(?:s|isements?)?|adsense|sponsor(?:s|ed)?|promo(?:s|tions?)?|banner|cookies?|cookie-(?:banner|consent|notice)|consent|gdpr|notices?|alerts?
 |sidebar|side-bar|comments?|comment-list|disqus|disqus_thread|respond|replies|menu|navbar|navigation|nav|breadcrumbs?|share|share-buttons|sharing|social|related|related-posts
 |recommended|newsletter|subscribe|signup|popup|modal|overlay|footer|site-footer|masthead|site-header|page-header|pagination|pager|toolbar|widget|skip-link|complementary
 |contentinfo|search""", re.X | re.I)
#: Blocks of running text.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote li dd dt td th figcaption caption article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+(?:["'][^>]*+)?+)>?""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "parts", "chars", "tags", "link_chars", "link_tags", "density", "sum", "inside", "named")

    def __init__(self, tag: str, parent: "Node | None", named: bool = False):
        self.tag, self.parent, self.named = tag, parent, named  # named: its tag, class, id or role says that it is no article text
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.children: list[Node] = []
        self.parts: list = []  # texts and nodes in page order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def hidden(attributes: str) -> bool:
    for m in _ATTRIBUTE.finditer(attributes) if "hidden" in attributes.lower() or "=" in attributes else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether the tag or a whole class name, id or role says so; ids of headings and sections are made from their titles."""
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if tag in HEADINGS or tag in ("body", "html", "article", "main") or "=" not in attributes:
        return False
    values = {m[1].lower(): (m[2] or m[3] or m[4] or "").split() for m in _ATTRIBUTE.finditer(attributes)}
    section = tag == "section" or "section" in map(str.lower, values.get("class", ()))
    return any(UNWANTED.fullmatch(v) for name in ("class", "id", "role") if name != "id" or not section for v in values.get(name, ()))


def parse(page: str) -> Node:
    """The tree of a page without hidden elements; unwanted ones are ``named``."""
    root = Node("body", None)
    stack, at, muted = [root], 0, []  # muted: open elements below a hidden one, itself first
    # how many elements of each tag are open: in all, from the nearest scope on, below a hidden one; searches only run if they will find
    open_, regions, hushed = Counter(), [Counter()], Counter()

    def push(node: Node) -> None:
        stack.append(node)
        open_[node.tag] += 1
        if node.tag in SCOPE:
            regions.append(Counter())
        regions[-1][node.tag] += 1

    def close(tags) -> None:
        """Close the topmost element of ``tags``, which is open, and all in it."""
        tag = None
        while tag not in tags:
            tag = stack.pop().tag
            open_[tag] -= 1
            regions[-1][tag] -= 1
            if tag in SCOPE:
                regions.pop()

    def mute(tag: str) -> None:
        muted.append(tag)
        hushed[tag] += 1

    def text(raw: str) -> None:
        if raw and not muted:
            stack[-1].parts.append(entities.unescape(raw) if "&" in raw else raw)

    for m in iter(lambda: _TAG.search(page, at), None):
        text(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if muted:
                if hushed[tag]:
                    last = None
                    while last != tag:
                        last = muted.pop()
                        hushed[last] -= 1
                elif tag in ("body", "html") or tag in ("article", "main", "section") and open_[tag]:
                    muted.clear()
                    hushed.clear()
                if muted or tag not in ("article", "main", "section") or not open_[tag]:
                    continue
            if open_[tag]:
                close({tag})
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at) if not m[0].endswith("/>") else None
            at = end.end() if end else at if m[0].endswith("/>") else len(page)
            continue
        if tag in VOID:
            if not muted:
                stack[-1].parts.append("\n" if tag == "br" else Node(tag, stack[-1]) if tag == "hr" else "")
                stack[-1].tags += 1
            continue
        if muted:
            if not m[0].endswith("/>"):
                if muted[-1] in CLOSES.get(tag, ()) or muted[-1] == "p" and tag in BLOCK and len(muted) > 1:
                    hushed[muted.pop()] -= 1
                mute(tag)
            continue
        if tag in ("body", "html"):
            continue
        if tag in BLOCK or tag in CLOSES:
            shut = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCK else set())
            if any((regions[-1] if tag in BLOCK else open_)[t] > 0 for t in shut):
                close(shut)
        if tag == "head" or tag not in ("article", "main", "h1") and hidden(m[3]):
            if not m[0].endswith("/>"):
                mute(tag)
            if tag in BLOCK:
                stack[-1].parts.append(Node("hr", stack[-1]))
            continue
        node = Node(tag, stack[-1], unwanted(tag, m[3], stack[-1].inside))
        stack[-1].children.append(node)
        stack[-1].parts.append(node)
        if not m[0].endswith("/>"):
            push(node)
    text(page[at:])
    return root


def in_order(root: Node) -> list[Node]:
    """Every element, parents before children."""
    out = [root]
    for node in out:
        out.extend(node.children)
    return out


def measure(root: Node) -> list[Node]:
    """Set counts, composite densities and sums of all nodes."""
    nodes = in_order(root)
    for node in reversed(nodes):
        own = sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        node.chars += own + sum(c.chars for c in node.children)
        node.tags += len(node.children) + sum(c.tags for c in node.children)
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, 1
        else:
            node.link_chars, node.link_tags = sum(c.link_chars for c in node.children), sum(c.link_tags for c in node.children)
    page_links = root.link_chars / max(root.chars, 1)
    for node in nodes:
        if node.chars:
            rest, links = max(node.chars - node.link_chars, 1), max(node.link_chars, 1)
            base = math.log(node.chars / rest * node.link_chars + page_links * node.chars + math.e)
            weight = math.log(node.chars / links * max(node.tags, 1) / max(node.link_tags, 1) + 1e-9)
            node.density = node.chars / max(node.tags, 1) * max(weight, 0.0) / max(math.log(base), 0.1)
    for node in nodes:
        node.sum = sum(c.density for c in node.children)
    return nodes


def without_named(root: Node, share: float = 0.1) -> None:
    """Take the ``named`` elements out of the tree.

    One stays if it holds an article or main, or more than half of the page's text; the latter goes only
    if article or main elsewhere hold at least ``share`` of its text.
    """
    nodes = in_order(root)
    own = {n: sum(len("".join(p.split())) for p in n.parts if isinstance(p, str)) for n in nodes}
    chars, marked = dict(own), {n: n.tag in ("article", "main") for n in nodes}
    for n in reversed(nodes[1:]):
        chars[n.parent] += chars[n]
        marked[n.parent] |= marked[n] and chars[n] > 0
    covered = {}
    for n in nodes:
        covered[n] = n.named and not marked[n] or n is not root and covered[n.parent]
    article = sum(own[n] for n in nodes if n.inside and not covered[n])
    gone = {n for n in nodes[1:] if n.named and not marked[n] and (2 * chars[n] <= chars[root] or article > 0 and article >= share * chars[n])}
    for parent in {n.parent for n in gone}:
        parent.children = [c for c in parent.children if c not in gone]
        parent.parts = [p if p not in gone else Node("hr", parent) if p.tag in BLOCK else "" for p in parent.parts]


def main_node(root: Node) -> tuple[Node, float]:
    """The node with the largest sum (among equals one in an article or main) and the smallest density on its path to the body."""
    best = max(measure(root), key=lambda n: (n.sum, n.inside))
    threshold, node = best.density, best
    while node is not None:
        threshold = min(threshold, node.density)
        node = node.parent
    return best, threshold


def blocks(root: Node, best: Node, threshold: float) -> list[str]:
    """Texts of the kept blocks in page order.

    A block whose density reaches the threshold is kept. Below it a block goes if more than half of it
    are links, or if it stands outside ``best`` and holds no heading, paragraph, list or table.
    """
    out: list[str] = []
    line: list[str] = []
    prose, path = set(), set()
    for x in reversed(in_order(root)):
        if x in prose or x.tag in PROSE:
            prose |= {x, x.parent}
    node = best
    while node is not None:
        path.add(node)
        node = node.parent

    def close() -> None:
        words = "".join(line).split()
        if words:
            out.append(" ".join(words))
        line.clear()

    todo: list = [(root, best is root)]
    while todo:
        x, within = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            line.append(x)
        else:
            within = within or x is best or x.tag in PROSE
            low = x not in path and x.tag in BLOCK and x.density < threshold
            gone = low and (x.tag not in ("p", *HEADINGS) and x.link_chars > 0.5 * x.chars or not within and x not in prose)
            if x.tag in BLOCK:
                close()
                todo.append((None, within))
            if not gone:
                todo.extend((p, within) for p in reversed(x.parts))
    close()
    return out


def main_text(page: str | None) -> str:
    root = parse(page or "")
    without_named(root)
    return "\n\n".join(blocks(root, *main_node(root)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
