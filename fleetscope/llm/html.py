"""Main text of web pages by composite text density."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_TAG = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_BLANK = re.compile(r"[\x20\x09-\x0D]+")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^\x00-\x7f]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
                    "strike strong sub sup time tt u var wbr img".split())
#: Elements that never hold a page's text, and those that weigh next to nothing unless ``_settle`` finds an article in them.
_SILENT = frozenset("script style noscript template iframe object embed svg canvas audio video head title select option input textarea".split())
_DROPPED = frozenset("nav aside footer form button dialog menu".split())
#: A name in class, id, role or aria-label weighs an element down if it is made of these words only,
_MARKS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu sidebar footer masthead "
                   "breadcrumb breadcrumbs comment comments disqus reply replies cookie cookies consent gdpr notice notices notification popup modal "
                   "newsletter subscribe subscription signup login share sharing social related recommended widget skip hidden contentinfo search "
                   "complementary alert paywall pagination pager bio".split())
#: or of these and words for place, shape and owner: "sidebar-left", "post-comments", "ad-slot", not "has-sidebar", "comments-open" or "related-work".
_SHAPES = frozenset("left right top bottom upper lower main primary secondary site page global box list item items bar area block container wrapper wrap inner "
                    "outer section column col links buttons post posts user users reader readers author authors thread slot unit google this these form story stories "
                    "article articles news row widgets module panel holder body count title heading header new all more by".split())
#: What such a name or element weighs: its text counts for so much in the density.
_WEIGHT = 1e-6
_PARAGRAPH_ENDS = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main "
                            "nav ol p pre section table ul li dd dt tr td th".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LINES = frozenset("p h1 h2 h3 h4 h5 h6 pre".split())
_LIMITS = frozenset("ul ol dl table article section div body main td th blockquote".split())
_STOPS = _LIMITS | frozenset("li dt dd tr option".split())


class Node:
    __slots__ = ("tag", "marked", "silent", "named", "group", "parts", "chars", "tags", "link_chars", "link_tags", "density", "sum", "above", "left_out", "block", "stop",
                 "in_article", "shares")

    def __init__(self, tag: str, above: Node | None, attributes: str = ""):
        found = _attributes(attributes) if attributes else {}
        self.tag, self.above, self.parts, self.left_out = tag, above, [], False
        # Nearest element, itself included, that is not inline, and that can end a list item or cell or keeps it open.
        self.block = self if above is None or tag not in _INLINE else above.block
        self.stop = self if above is None or tag in _STOPS else above.stop
        self.in_article = above is not None and (above.in_article or above.tag in ("article", "main"))
        self.silent, self.named = tag in _SILENT, bool(found) and _named(tag, found)
        self.marked = self.silent or tag not in ("article", "main") and (self.named or _set_apart(tag, found, above))
        # What the parts of one text have in common: their class, or being sections.
        self.group = (tag, kind) if (kind := found.get("class", "").strip()) or tag == "section" else None


def _attributes(text: str) -> dict[str, str]:
    """Attributes by name, an empty text for one without a value. The first of a repeated name counts."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return found


def _is_mark(name: str) -> bool:
    words = [w.lower() for w in _NAME_PARTS.findall(name)]
    return any(w in _MARKS for w in words) and all(w in _MARKS or w in _SHAPES or w.isdigit() for w in words)


def _named(tag: str, attributes: dict[str, str]) -> bool:
    """Whether a whole class or role, the id or the whole label marks an element. The id of a heading or paragraph is an anchor of its text."""
    names = attributes.get("class", "").split() + attributes.get("role", "").split() + [attributes.get("aria-label", "")]
    return any(map(_is_mark, names)) or tag not in _LINES and _is_mark(attributes.get("id", ""))


def _set_apart(tag: str, attributes: dict[str, str], above: Node | None) -> bool:
    """Whether an element is no part of an article by its tag or because it is hidden. A header counts unless it stands in an article."""
    if tag in _DROPPED:
        return True
    if tag == "header" and not above.in_article:
        return True
    return ("hidden" in attributes and attributes["hidden"].lower() != "until-found" or attributes.get("aria-hidden", "").strip().lower() == "true"
            or re.search(r"\bdisplay\s*:\s*none\b", attributes.get("style", ""), re.I) is not None)


def _settle(root: Node) -> None:
    """Take back the mark of every element that holds the page's article: an article or main element with more unlinked text than those
    outside marked elements, or, on a page without such an element, more than half of all unlinked text."""
    nodes, stack = [], [(root, False, False)]
    while stack:
        node, link, apart = stack.pop()
        nodes.append((node, link, apart))
        stack += [(p, link or p.tag == "a", apart or p.marked) for p in reversed(node.parts) if isinstance(p, Node) and not p.silent]
    if not any(node.marked for node, _, _ in nodes):
        return
    # All unlinked characters below a node, those outside elements marked in it, and the most an article in it has.
    plain, shown, held, outside = {}, {}, {}, 0
    for node, link, apart in reversed(nodes):
        below = [p for p in node.parts if isinstance(p, Node) and not p.silent]
        own = 0 if link else sum(len(_BLANK.sub("", unescape(p))) for p in node.parts if isinstance(p, str))
        plain[node] = own + sum(plain[p] for p in below)
        shown[node] = own + sum(shown[p] for p in below if not p.marked)
        held[node] = max([held[p] for p in below], default=0)
        if node.tag in ("article", "main") and not node.named:
            held[node] = max(held[node], shown[node])
            outside = outside if apart else max(outside, shown[node])
    for node, _, _ in nodes:
        if node.marked and (held[node] > outside or not outside and 2 * plain[node] > plain[root]):
            node.marked = False


def _tag_end(html: str, at: int, quotes: bool) -> tuple[int, bool]:
    """Place after the ">" that ends the tag whose attributes begin at ``at``, and whether quoted values could be told apart. There is a ">" ahead.
    A quote without an end is a plain character."""
    pos = at
    while quotes:
        pos = _PLAIN.match(html, pos).end()
        if pos == len(html):
            return html.index(">", at) + 1, False  # quotes cross the end of the tag: from here on they are not read at all
        if html[pos] == ">":
            return pos + 1, True
        closing = html.find(html[pos], pos + 1)
        if closing < 0:
            return html.index(">", at) + 1, False
        pos = closing + 1
    return html.index(">", at) + 1, False


def parse(html: str) -> Node:
    """The page as a tree, with the end tags that HTML lets authors leave out. Unclosed and crossing tags do no harm. One pass over the page;
    the tree is walked without recursion, so pages may be long, broken and deeply nested."""
    root = at = Node("html", None)
    pos, quotes, last = 0, True, html.rfind(">")
    opened: Counter[str] = Counter()

    def leave(node: Node) -> Node:
        """Close everything down to ``node``."""
        now = at
        while now is not node:
            opened[now.tag] -= 1
            now = now.above
        opened[node.tag] -= 1
        return node.above

    start = html.find("<")
    while 0 <= start:
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at.parts.append(html[pos:start])
            pos = len(html) if end < 0 else end + 3
            start = html.find("<", pos)
            continue
        closes = html.startswith("/", start + 1)
        name = _TAG.match(html, start + 1 + closes)
        if start > last or not name and html[start + 1:start + 2] not in ("!", "?"):
            if start > last and (name or html[start + 1:start + 2] in ("!", "/")):
                break  # the page ends within a tag: what follows is no text
            start = html.find("<", start + 1)
            continue
        at.parts.append(html[pos:start])
        if not name:
            pos = html.index(">", start) + 1
            start = html.find("<", pos)
            continue
        tag = name[0].lower()
        pos, quotes = _tag_end(html, name.end(), quotes)
        attributes = html[name.end():pos - 1]
        if tag in ("html", "body"):
            pass
        elif closes:
            if opened[tag]:
                node = at
                while node.tag != tag:
                    node = node.above
                at = leave(node)
        else:
            if tag in _PARAGRAPH_ENDS and at.block.tag == "p":
                at = leave(at.block)
            if ends := _CLOSES.get(tag):
                node = at.stop
                while node.above is not None and node.tag not in ends and node.tag not in _LIMITS:
                    node = node.above.stop
                if node.tag in ends and node.above is not None:
                    at = leave(node)
            node = Node(tag, at, attributes)
            at.parts.append(node)
            if tag in _RAW and not attributes.endswith("/"):
                found = re.compile(rf"</{tag}\b", re.I).search(html, pos)
                node.parts.append(html[pos:found.start() if found else len(html)])
                pos = html.index(">", found.end()) + 1 if found and found.end() <= last else len(html)
            elif tag not in _VOID and not (attributes.endswith("/") and tag in ("svg", "path")):
                at = node
                opened[tag] += 1
        start = html.find("<", pos)
    at.parts.append(html[pos:start if start >= 0 else len(html)])
    _settle(root)
    return root


def _in_order(root: Node) -> list[Node]:
    """Nodes that may hold text, each before its children."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        found.append(node)
        stack += [p for p in reversed(node.parts) if isinstance(p, Node) and not p.silent]
    return found


def densities(root: Node) -> list[Node]:
    """Composite text density of every node: characters per tag, less the more of them are links and the more tags are links'. Elements and names
    that seldom hold an article are weighed down, with all that is in them."""
    nodes = _in_order(root)
    for node in reversed(nodes):
        children = [p for p in node.parts if isinstance(p, Node) and not p.silent]
        own = sum(len(_BLANK.sub("", unescape(p))) for p in node.parts if isinstance(p, str))
        node.chars = own + sum(c.chars for c in children)
        node.tags = sum(c.tags + 1 for c in children)
        link = node.tag == "a"
        node.link_chars = node.chars if link else sum(c.link_chars for c in children)
        node.link_tags = sum(c.link_tags + (c.tag == "a") for c in children)
    share = root.link_chars / root.chars if root.chars else 0.0
    weights = {}
    for node in nodes:
        weights[node] = (weights[node.above] if node.above is not None else 1.0) * (_WEIGHT if node.marked else 1.0)
        node.density = _density(node, share) * weights[node]
    for node in nodes:
        node.sum = sum(p.density for p in node.parts if isinstance(p, Node) and not p.silent)
    return nodes


def _density(node: Node, share: float) -> float:
    if not node.chars:
        return 0.0
    plain = max(node.chars - node.link_chars, 1)
    base = math.log(node.chars / plain * node.link_chars + share * node.chars + math.e)
    ratio = node.chars / max(node.link_chars, 1) * max(node.tags, 1) / max(node.link_tags, 1)
    return node.chars / max(node.tags, 1) * math.log(max(ratio, 1.0)) / math.log(base + 1.0)


def _blocks(node: Node) -> list[Node]:
    """Children that are neither inline nor a mere break."""
    return [p for p in node.parts if isinstance(p, Node) and not p.marked and p.tag not in _INLINE and p.tag not in _VOID]


def _linked(node: Node) -> bool:
    """Whether a node is a list of links: several, with more than half of its text."""
    return node.link_tags > 1 and 2 * node.link_chars > node.chars


def _dense_nodes(nodes: list[Node]) -> tuple[set[Node], float]:
    """The nodes that composite text density marks, and the threshold: the smallest density on the path from the node with the
    largest sum of child densities to the body. From the body on, every node at or above it marks the node with the largest sum in it.
    Paragraphs have no sum of their own, only what holds blocks has: else an open <b> makes a paragraph outweigh its article."""
    root, size = nodes[0], {}
    best: dict[Node, Node] = {}
    for node in reversed(nodes):
        size[node] = node.sum if node is root or _blocks(node) else 0.0
        below = [best[p] for p in node.parts if isinstance(p, Node) and not p.silent]
        best[node] = max([node, *below], key=size.__getitem__)
    at = best[root]
    threshold = at.density
    while at.above is not None:
        at = at.above
        threshold = min(threshold, at.density)
    found, stack = set(), [root]
    while stack:
        node = stack.pop()
        if node in found or not node.chars or node.density < threshold:
            continue
        found.add(best[node])
        if node not in found:
            stack += [p for p in node.parts if isinstance(p, Node) and not p.silent]
    return found, threshold


def _common(nodes: list[Node], marked: set[Node]) -> Node:
    """The smallest element that holds all marked nodes."""
    for node in reversed(nodes):
        node.shares = (node in marked) + sum(p.shares for p in node.parts if isinstance(p, Node) and not p.silent)
        if node.shares == len(marked):
            return node
    return nodes[0]


def _belongs(node: Node) -> bool:
    """Whether the element above a node is part of the same text: it has paragraphs or headings of its own, further sections or elements of
    the node's class, or more than a tenth of the node's unlinked text beside it."""
    above = node.above
    for other in _blocks(above):
        if other is not node and other.chars and not _linked(other) and (other.tag in _LINES or node.group is not None and other.group == node.group):
            return True
    plain = node.chars - node.link_chars
    return 10 * (above.chars - above.link_chars - plain) > plain


def main_node(root: Node) -> Node:
    """The element with the article: the smallest that holds all nodes marked by density, widened as long as what is around belongs to it, and
    to the article element it is in. In it, below the density threshold, elements and names that are weighed down, lists of links and
    articles beside the marked nodes are left out, nothing else. A page of bare text is its own article."""
    nodes = densities(root)
    marked, threshold = _dense_nodes(nodes) if max(n.sum for n in nodes) > 0 else ({root}, 0.0)
    top = _common(nodes, marked)
    node = top
    while node is not None and node.tag != "article":
        node = node.above
    top = node if node is not None and node.density >= threshold else top
    while top.above is not None and top.tag != "article" and _belongs(top):
        top = top.above
    holders = set()
    for node in marked:
        while node is not None and node not in holders:
            holders.add(node)
            node = node.above
    stack = [(top, top.tag == "article" or top in marked)]
    while stack:
        node, whole = stack.pop()
        for child in node.parts:
            if not isinstance(child, Node) or child.silent:
                continue
            apart = child not in holders and not whole and child.tag not in _INLINE and child.tag not in _LINES and (child.tag == "article" or _linked(child))
            if (child.marked or apart) and (child.density < threshold or threshold == 0):
                child.left_out = True
            else:
                stack.append((child, whole or child.tag == "article" or child in marked))
    return top


def text_of(node: Node) -> str:
    """All text below a node: blocks in page order, white space inside one as one space, joined by one space."""
    pieces, stack = [], [node]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            pieces.append(part)
        elif not part.silent and not part.left_out or part is node:
            around = "" if part.tag in _INLINE and part.tag not in ("img", "wbr") else " "
            stack += [around, *reversed(part.parts), around]
        else:
            pieces.append(" " if part.tag not in _INLINE else "")
    return _BLANK.sub(" ", unescape("".join(pieces))).strip(" ")


def main_text(html: str | None) -> str:
    return text_of(main_node(parse(html))) if html else ""


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([main_text(h) for h in batch.column(2).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Return (page_id, url, text, n_chars) with the main text of every page.

    Pages are independent, so there is no shuffle; a task holds one batch of pages and one tree. Text density, links taken off, of every node and
    the sums of its children choose the subtree, with thresholds along the path to the body. Elements and whole names of class, id and role that stand
    for menus, footers, sidebars, forms, notices, adverts and comments weigh next to nothing, unless they hold the page's article or, without one, most of
    its unlinked text; what is weighed down, and lists of links around the dense nodes, falls below the threshold and is left out. Scripts and styles are
    no text. All other text of the subtree comes whole.

    Null or empty html, and pages without text, give an empty text. Of equally dense subtrees the outer, then the first one counts. Pages that end
    within a tag or leave tags open are read as far as they go, in time that grows with their length, whatever is broken in them. Repeated rows each
    get their text; a null page_id or url stays null.
    """
    source = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    found = source.mapInArrow(_texts, "page_id bigint, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
