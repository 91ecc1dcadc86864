"""Main text of web pages by composite text density.

Every element of the page's tree has C characters of text, LC of them in links, T
tags and LT link tags below it. Its composite density is

    C/T * log(C*T / (LC*LT)) to base ln(C*LC/(C-LC) + C*LC_body/C_body + e)

(all counts 1 at least), which is low where text is linked. Text of elements that say that they are no
article (nav, footer, aside, forms, scripts, and classes or ids that name menus, adverts, notices or
comments) counts as linked, so that it is as dense as a menu and a long advert can't outweigh a short article.

The element whose blocks' densities have the largest sum is found; markup inside a paragraph or heading is
no block. The smallest density on the path from the body to it is the threshold. Every other subtree that reaches it is
kept too, as its own element of the largest sum, in page order; so is text that stands beside elements. An
element below the threshold is searched further, since a list of links may stand beside its paragraphs; link
lists below it go, and what counts as linked by its name goes where its own density is below. A page without any
link has nothing that the threshold could tell apart, and is kept whole. An article or main element
around a found one is taken whole if it is denser than the page, so that its short paragraphs stay.

A form, or an element that only a
class, an id, a role or a hidden mark names, is no noise if it holds most of the page's unlinked text or the element
of the largest sum. Where an article or main element with text stands outside all that is named, such an
element is none only inside one, if it holds most of its unlinked text.

Defined results: null or empty html, or a page without text: empty string. Unclosed
or truncated markup is repaired as browsers do; a page of any length is read whole. Nothing is
capped. Rows with a null id or url keep it. Repeated rows get equal results; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import clean

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
NOISE = frozenset("nav footer header aside script style noscript template textarea title iframe noframes xmp head menu button select input option dialog svg canvas object embed".split())
CLOSES_P = BLOCK - {"br", "option", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html", "head"}
#: What a start tag ends, and the elements that the search does not leave.
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar toolbar form".split())
#: Words in a class or id that mark what is no article.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies cookiebanner cookiebar disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification overlay popup promo promoted promotion related replies respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: A class or id with one of these says what an element has or lacks, not what it is.
NOT_NAMES = frozenset("has have with without no not layout".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("attributes", "blocks", "chars", "children", "density", "holder", "kept", "link_chars", "link_tags", "name", "noise", "parent", "peak", "tags", "total")

    def __init__(self, name: str, parent: Node | None, attributes: str = "") -> None:
        self.name, self.parent, self.attributes = name, parent, attributes
        self.children: list[Node | str] = []
        self.noise = self.kept = self.blocks = False
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0
        self.holder: Node | None = None
        self.peak = self


class _Open:
    """The open elements, and where those of each name stand among them; every element is pushed and popped once."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.places = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.name].append(len(self.nodes))
        self.nodes.append(node)

    def last(self, names: Iterable[str]) -> int:
        """Place of the innermost open element of these names; 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places[n]), default=0)

    def close(self, place: int) -> None:
        """Closes the element there and all in it."""
        for node in self.nodes[place:]:
            self.places[node.name].pop()
        del self.nodes[place:]

    def start(self, name: str) -> None:
        """Closes what a start tag of this name ends."""
        closes, inside = CLOSED_BY.get(name, ((), ()))
        if closes:
            bound = self.last(inside)
            found = [x[i] for x in (self.places[n] for n in closes) if (i := bisect_right(x, bound)) < len(x)]
            if found:
                self.close(min(found))
        if name in CLOSES_P and (place := self.last(("p",))) > self.last(("td", "th", "button", "object", "table")):
            self.close(place)


def parse(page: str) -> Node:
    """The page's tree, in time that grows with its length; text stays undecoded strings among the children."""
    root = Node("html", None)
    up = _Open(root)
    at, stop = 0, len(page)
    while at < stop:
        node = up.nodes[-1]
        cut = page.find("<", at)
        if cut < 0:
            node.children.append(page[at:])
            break
        if cut > at:
            node.children.append(page[at:cut])
        m = _TAG.match(page, cut)
        if m is None:
            if page.startswith("</", cut) or re.match(r"<[a-zA-Z]", page[cut : cut + 2]):
                end = page.find(">", cut)  # quotes don't match: the tag ends at the next sign
                m_end, name, closing, attributes = (end + 1 if end >= 0 else stop), re.match(r"</?([a-zA-Z][^\s/>]*)?", page[cut : cut + 64]).group(1), page.startswith("</", cut), ""
            else:
                node.children.append("<")
                at = cut + 1
                continue
        else:
            m_end, name, closing, attributes = m.end(), m.group(2), bool(m.group(1)), m.group(3) or ""
        at = m_end
        if not name:
            continue
        name = name.lower()
        if closing:
            if place := up.last((name,)):
                up.close(place)
            elif name == "p":
                node.children.append(Node("p", node))
            continue
        if name == "html":
            continue
        up.start(name)
        child = Node(name, up.nodes[-1], attributes)
        child.parent.children.append(child)
        if name in RAW:
            end = _raw_end(name).search(page, at)
            at = end.end() if end else stop
        elif name not in VOID:
            up.push(child)
    return root


@lru_cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I)


@lru_cache(maxsize=1 << 14)
def names_noise(value: str) -> bool:
    """Whether a class or id has a token that names noise: one of its whole words does, and none says that it is had or lacked."""
    for token in value.split():
        words = {w.lower() for w in _WORD.findall(token.partition("--")[0])}
        if words & NOISE_WORDS and not words & NOT_NAMES:
            return True
    return False


def _is_named(node: Node) -> bool:
    """Whether the element's attributes, or its being a form, say that it is no article."""
    if node.name == "form":
        return True
    if node.attributes and node.name not in ("body", "article", "main"):
        for m in _ATTRIBUTE.finditer(node.attributes):
            key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
            if key == "role":
                if value.strip().lower() in NOISE_ROLES:
                    return True
            elif key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true":
                return True
            elif key in ("class", "id") and names_noise(value):
                return True
    return False


def _order(root: Node) -> list[Node]:
    """All elements, parents first; what is inside noise is noise."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        up = node.parent
        node.noise = up is not None and up.noise or node.name in NOISE
        node.holder = up is not None and up.holder or (node if node.name in ("article", "main") else None)
        out.append(node)
        stack.extend(x for x in reversed(node.children) if not isinstance(x, str))
    named = [n for n in out if not n.noise and _is_named(n)]
    if named:
        _take_out(out, named)
    return out


def _take_out(nodes: list[Node], named: list[Node]) -> None:
    """Marks the named elements as noise, except those that hold what the page is about."""
    root, marked, inside, plain = nodes[0], set(map(id, named)), set(), set()
    for node in nodes:
        if id(node) in marked or id(node.parent) in inside:
            inside.add(id(node))
    for node in reversed(nodes):  # elements with text outside all noise
        if not node.noise and id(node) not in marked and any(not x.isspace() if isinstance(x, str) else id(x) in plain for x in node.children):
            plain.add(id(node))
    free = any(n.name in ("article", "main") and id(n) not in inside and id(n) in plain for n in nodes)
    within = [(n, top) for n in named if (top := n.holder if free else root)]
    if within:
        _count(nodes)
        around = set() if free or not root.peak.total else set(map(id, _path(root.peak)))
        marked -= {id(n) for n, top in within if n.chars and (2 * (n.chars - n.link_chars) > top.chars - top.link_chars or id(n) in around)}
    for node in nodes:
        node.noise = node.noise or id(node) in marked or node.parent is not None and node.parent.noise


def _text_length(text: str) -> int:
    return len(text) - text.count(" ") if "&" not in text else len(html.unescape(text).replace(" ", ""))


def _density(c: int, t: int, lc: int, lt: int, share: float) -> float:
    """Composite density of ``c`` characters and ``t`` tags, ``lc`` and ``lt`` of them in links."""
    if not c:
        return 0.0
    links, t, lt = max(lc, 1), max(t, 1), max(lt, 1)
    base = math.log(c / max(c - lc, 1) * links + share * c + math.e)
    return c / t * math.log(max(c / links * t / lt, 1)) / math.log(base) if base > 1 else c / t


def _body_of(nodes: list[Node]) -> Node:
    return next((n for n in nodes if n.name == "body"), nodes[0])


def _body_share(nodes: list[Node]) -> float:
    """Linked share of the body's text."""
    body = _body_of(nodes)
    return body.link_chars / max(body.chars, 1)


def _count(nodes: list[Node]) -> None:
    """Counts, densities, their sums over blocks and the largest sum below; ``nodes`` has parents first.

    Noise counts as links do: all of its text is linked, all of its tags are link tags.
    """
    for node in reversed(nodes):
        inner = [x for x in node.children if not isinstance(x, str)]
        node.chars = sum(_text_length(x) for x in node.children if isinstance(x, str)) + sum(x.chars for x in inner)
        node.tags = len(inner) + sum(x.tags for x in inner)
        linked = node.noise or node.name == "a"
        node.link_chars = node.chars if linked else sum(x.link_chars for x in inner)
        node.link_tags = node.tags if node.noise else sum((x.name == "a" or x.noise) + x.link_tags for x in inner)
        node.blocks = node.name in BLOCK and node.name != "br" or any(x.blocks for x in inner)
    share = _body_share(nodes)
    for node in reversed(nodes):
        node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        inner = [x for x in node.children if not isinstance(x, str) and x.blocks]
        node.total = sum(x.density for x in inner)
        below = max((x.peak for x in inner), key=lambda x: x.total, default=node)
        node.peak = below if below.total > node.total else node


def measure(root: Node) -> list[Node]:
    """All elements, parents first, with counts and densities."""
    nodes = _order(root)
    _count(nodes)
    return nodes


def _path(node: Node) -> list[Node]:
    """The element and those around it, from the inside."""
    path, up = [], node
    while up is not None:
        path.append(up)
        up = up.parent
    return path


def main_node(root: Node) -> tuple[Node, float]:
    """The element with the largest sum of its blocks' densities, and the body path's least density."""
    return _found(root)[:2]


def _whole(node: Node, page: float) -> Node:
    """The article or main element around an element, if it is denser than the page; else the element."""
    return node.holder if node.holder is not None and not node.holder.noise and node.holder.density >= page else node


def _found(root: Node) -> tuple[Node, float, float, float]:
    """The main node, the threshold, the density of the body, and its linked share."""
    nodes = measure(root)
    body, share = _body_of(nodes), _body_share(nodes)
    best = root.peak if root.peak.total else body
    if not any(n.name == "a" for n in nodes):
        best = root  # no link anywhere: nothing to tell text from
    return _whole(best, body.density), min((n.density for n in _path(best) if n.name != "html" and n.chars), default=0.0), body.density, share


def _is_link_list(node: Node, threshold: float) -> bool:
    return node.chars > 0 and node.name in ("ul", "ol", "div", "table", "section") and node.link_chars > 0.8 * node.chars and node.link_tags > 2 and node.density < threshold


def _pieces(node: Node) -> list[Node | list[Node | str]]:
    """Children that are or hold blocks, and runs of text and other elements between them."""
    out: list[Node | list[Node | str]] = []
    for x in node.children:
        if isinstance(x, str) or not x.blocks:
            if not out or isinstance(out[-1], Node):
                out.append([])
            out[-1].append(x)
        else:
            out.append(x)
    return out


def _run_density(run: list[Node | str], noise: bool, share: float) -> float:
    inner = [x for x in run if not isinstance(x, str)]
    t = len(inner) + sum(x.tags for x in inner)
    c = sum(_text_length(x) for x in run if isinstance(x, str)) + sum(x.chars for x in inner)
    lc, lt = (c, t) if noise else (sum(x.link_chars for x in inner), sum((x.name == "a" or x.noise) + x.link_tags for x in inner))
    return _density(c, t, lc, lt, share)


def contents(root: Node) -> tuple[list[Node | list[Node | str]], float]:
    """Subtrees and runs of text that reach the threshold, in page order, and the threshold."""
    best, threshold, page, share = _found(root)
    best.kept = True
    stack = [root]
    while stack:
        node = stack.pop()
        if node.kept or _is_link_list(node, threshold):
            continue
        if node.density and node.density >= threshold:
            found = node.peak if node.peak.total else node
            if not found.kept:
                _whole(found, page).kept = True
        if not node.kept:
            stack.extend(x for x in reversed(_pieces(node)) if isinstance(x, Node))
    out, stack = [], [(root, False)]
    while stack:
        item, noise = stack.pop()
        if isinstance(item, list):
            if (density := _run_density(item, noise, share)) and density >= threshold:
                out.append(item)
        elif item.kept:
            out.append(item)
        elif not _is_link_list(item, threshold):
            stack.extend((x, item.noise) for x in reversed(_pieces(item)))
    return out, threshold


def extract(page: str | None) -> str:
    """The article's text; blocks in page order, joined by one space."""
    if not page:
        return ""
    found, threshold = contents(parse(page))
    parts: list[str] = []
    for top in found:
        stack: list[Node | str] = [top] if isinstance(top, Node) else top[::-1]
        parts.append(" ")
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                parts.append(html.unescape(item))  # one by one: no reference reaches across a tag
            elif item is top or not item.noise:
                if item is not top and _is_link_list(item, threshold):
                    continue
                if item.name in BLOCK:
                    parts.append(" ")
                    stack.append(" ")
                stack.extend(reversed(item.children))
        parts.append(" ")
    return _SPACE.sub(" ", "".join(parts)).strip()


def extract_pages(df: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, ``text`` and its number of code points, one row per input row."""
    kept = clean(df, *keep, page)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)
    return kept.mapInArrow(run, f"{schema}, text string, n_chars long")
