"""Main text of web pages by composite text density.

A tolerant parser builds the page's nodes.  Each node's density is its characters a tag, adjusted by its links; the
subtree whose children's densities sum highest is the main one, and the least density on the path from there to the body
is the threshold by which its neighbours are taken in.  Elements that are never an article's text (menus, forms, scripts,
notices, reader comments and the like, by tag, role or class) leave first.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm import common

#: Possessive, so that no character is looked at twice: comments and declarations, a tag's name, and the rest of a tag with quotes.
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*+>?", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("script style noscript template title head nav header footer aside form button select textarea input option iframe object embed svg canvas math audio video map dialog menu fieldset label xmp noembed noframes".split())
BLOCKS = frozenset("html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address hr center details summary hgroup search".split())
_CLOSES_P = BLOCKS | frozenset("nav header footer aside form fieldset menu dialog".split())
_P = frozenset(["p"])
_HOLDS_P = frozenset("td th table article section div li".split())
_HOLDS_INLINE = frozenset("td th table article body".split())
_RAW_ENDS = {x: re.compile(rf"</{x}\s*+>", re.I) for x in RAW}
#: A start tag closes an open element of these, up to the nearest of the second set.
_IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|adsense|banner|sponsor|sponsored|promo|promotion|promoted|cookie|cookies|consent|gdpr|notice|notices|notification"
    r"|alert|popup|modal|overlay|paywall|subscribe|subscription|newsletter|signup|login|sidebar|side|widget|rail|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|toc|pagination|pager"
    r"|header|masthead|footer|foot|copyright|comment|comments|commentlist|reply|replies|respond|discussion|disqus|share|sharing|social|related|recommended|recommendations|more-stories|trending|tags|skip|search|form|toolbar)(?:$|[\s_\d-])",
    re.I,
)
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comment|comments|commentlist|reply|replies|respond|discussion|disqus)(?:$|[\s_\d-])", re.I)
#: ``has-sidebar``, ``no-header`` and the like say what a page has, not what the element is.
_ABOUT = re.compile(r"(?:^|(?<=\s))(?:has|with|no|without|hide|show|is|js)[-_]\S+", re.I)
_ARTICLE = frozenset(["article", "main"])
_SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("chars", "density", "end", "first", "items", "link_chars", "link_tags", "named", "parent", "sums", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent, self.named = tag, parent, ""
        self.items: list[Node | str] = []


def _boilerplate(tag: str, rest: str) -> str:
    """``dropped`` for an element that goes whole, ``comments`` or ``named`` for one whose names say so, or nothing.

    The names do not count for body, main and article unless they are comments.
    """
    if tag in DROPPED:
        return "dropped"
    if not rest or tag in ("html", "body"):
        return ""
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return "dropped"
    if found.get("role", "").strip().lower() in _DROPPED_ROLES:
        return "dropped"
    names = " ".join(re.sub(r"([a-z])([A-Z])", r"\1-\2", _ABOUT.sub("", found.get(k, ""))) for k in ("class", "id", "itemprop"))
    if tag in _ARTICLE:
        return "dropped" if re.search(r"(?:^|[\s_-])(?:comments?|reply|replies)(?:$|[\s_\d-])", names, re.I) else ""
    return "" if not _NAMES.search(names) else "comments" if _COMMENTS.search(names) else "named"


class _Open:
    """Names of open elements and where each name stands, so that no look-up walks through them."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.at: dict[str, list[int]] = {}

    def push(self, name: str) -> None:
        self.at.setdefault(name, []).append(len(self.names))
        self.names.append(name)

    def cut(self, n: int) -> None:
        """Close all but the first ``n``."""
        while len(self.names) > n:
            self.at[self.names.pop()].pop()

    def has(self, name: str) -> bool:
        return bool(self.at.get(name))

    def last(self, names: frozenset[str] | set[str]) -> int:
        """The innermost of these names, -1 without one."""
        return max((self.at[x][-1] for x in names if self.at.get(x)), default=-1)


def parse(page: str) -> Node:
    """The page's tree without boilerplate, in time that grows with the page's length and no faster.

    Unclosed and stray tags are taken as browsers take them, as far as text matters; a tag that the page's end cuts off is dropped.
    """
    root = Node("#root", None)
    nodes, opened, skipped = [root], _Open(), _Open()  # skipped: the open elements from the outermost dropped one
    opened.push("#root")
    at, size = 0, len(page)

    def text(x: str) -> None:
        if x and not skipped.names:
            nodes[-1].items.append(html.unescape(x) if "&" in x else x)

    def cut(n: int) -> None:
        opened.cut(n)
        del nodes[n:]

    def close(tags: frozenset[str], stop: frozenset[str]) -> None:
        """Close the nearest open element of ``tags`` unless one of ``stop`` comes first."""
        i = opened.last(tags)
        if i > 0 and i >= opened.last(stop):
            cut(i)

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        m = _TAG.match(page, lt)
        if m is None:
            other = _OTHER.match(page, lt)
            if other is None:  # a bare sign
                text(page[at : lt + 1])
                at = lt + 1
                continue
            text(page[at:lt])
            at = other.end()
            if other[1] and not skipped.names:
                nodes[-1].items.append(other[1])
            continue
        text(page[at:lt])
        whole = _REST.match(page, m.end())
        if whole:
            rest, at = whole[1], whole.end()
        else:  # a quote that nothing closes
            end = page.find(">", m.end())
            if end < 0:
                break
            rest, at = page[m.end() : end], end + 1
        tag = m[2].lower()
        if m[1]:
            if skipped.names:
                if skipped.has(tag):
                    skipped.cut(skipped.at[tag][-1])
                elif tag in ("body", "html", "article", "main") and opened.has(tag):
                    skipped.cut(0)  # a dropped element that nothing closed ends with what holds it
                    close(frozenset([tag]), frozenset())
            elif tag in ("br", "p") and not opened.has(tag):
                nodes[-1].items.append(Node(tag, nodes[-1]))
            elif tag not in ("html", "body"):
                close(frozenset([tag]), frozenset() if tag in BLOCKS else _HOLDS_INLINE)
            continue
        if tag in RAW and not rest.endswith("/"):
            end = _RAW_ENDS[tag].search(page, at)
            at = end.end() if end else size
            continue
        closed = tag in VOID or rest.rstrip().endswith("/") and tag not in BLOCKS and tag not in _CLOSES_P
        if skipped.names:
            if closed:
                continue
            if tag == "p" and skipped.names[-1] == "p":
                skipped.cut(len(skipped.names) - 1)
            skipped.push(tag)
            if skipped.names != ["head", "body"]:
                continue
            skipped.cut(0)
        if tag in _CLOSES_P and opened.has("p"):
            close(_P, _HOLDS_P)
        if tag in _IMPLIED:
            close(*_IMPLIED[tag])
        if tag in ("html", "body") and opened.has(tag):
            continue
        why = _boilerplate(tag, rest)
        if why == "dropped":
            if not closed:
                skipped.push(tag)
            continue
        node = Node(tag, nodes[-1])
        node.named = why
        nodes[-1].items.append(node)
        if not closed:
            nodes.append(node)
            opened.push(tag)
    _drop_named(root)
    return root


def _drop_named(root: Node) -> None:
    """Drop what its names call boilerplate, unless it holds the page.

    A subtree stays if it has over half of the page's characters outside links, or all its article and main elements (names of
    comments: the first only, and only on a page without an article or main outside).
    """
    nodes = _order(root)
    if not any(x.named for x in nodes):
        return
    measure(root)
    text = root.chars - root.link_chars
    places = [x.first for x in nodes if x.tag in _ARTICLE]

    def stays(x: Node) -> bool:
        most = 2 * (x.chars - x.link_chars) > text
        every = bool(places) and x.first <= places[0] and places[-1] < x.end
        return most and (every or not places) if x.named == "comments" else most or every

    waiting = [root]
    while waiting:
        node = waiting.pop()
        node.items = [x for x in node.items if not isinstance(x, Node) or not x.named or stays(x)]
        waiting.extend(x for x in node.items if isinstance(x, Node))


def _order(root: Node) -> list[Node]:
    """The nodes, each before those in it; ``first`` and ``end`` bound the places of those within each."""
    found: list[Node] = []
    waiting: list[tuple[Node, bool]] = [(root, False)]
    while waiting:
        node, over = waiting.pop()
        if over:
            node.end = len(found)
            continue
        node.first = len(found)
        found.append(node)
        waiting.append((node, True))
        waiting.extend((x, False) for x in reversed(node.items) if isinstance(x, Node))
    return found


def measure(root: Node) -> list[Node]:
    """Densities and sums of all nodes, which come back in page order.

    With C characters and T tags, LC and LT those in links, N = C - LC, and B for the body:
    density = C/T * log(C/LC * T/LT) to the base ln(C/N * LC + LC_B/C_B * C + e); zeros below a bar count as one.
    """
    nodes = _order(root)
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for x in node.items:
            if isinstance(x, Node):
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.chars if x.tag == "a" else x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
            else:
                node.chars += len(x) - x.count(" ") - x.count("\n")
    share = root.link_chars / max(1, root.chars)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        if c == 0:
            node.density = 0.0
        else:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            node.density = max(0.0, c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / max(1e-9, math.log(base) if base > math.e else 1.0))
        node.sums = sum(x.density for x in node.items if isinstance(x, Node))
    return nodes


def chosen(root: Node) -> list[Node]:
    """The main subtrees in page order; none for a page without text."""
    nodes = [x for x in measure(root) if x.chars]
    if not nodes:
        return []
    body = next((x for x in nodes if x.tag == "body"), root)
    best = max((x for x in nodes if body.first <= x.first < body.end), key=lambda x: x.sums)  # of equal sums the first on the page
    if best.sums == 0:
        best = body
    article = None
    up = best
    while up is not None and up is not body:
        if up.tag in _ARTICLE:
            article = up
        up = up.parent
    path, up = [best], best
    while up is not body and up.parent is not None:
        up = up.parent
        path.append(up)
    threshold = min(x.density for x in path)
    top = best if article is None else article  # an article is taken whole; what lies beside it must pass the threshold
    found, below = [top], top
    for up in path[path.index(top) + 1 :]:
        for x in up.items:
            if isinstance(x, Node) and x is not below and x.chars and x.density >= threshold and x.link_chars * 2 <= x.chars:
                found.append(x)
        below = up
    place = {id(x): i for i, x in enumerate(nodes)}
    return sorted(found, key=lambda x: place[id(x)])


def blocks(tops: list[Node]) -> list[str]:
    """The text of each block, white space as one space; a line break inside a block is white space."""
    found: list[str] = []
    parts: list[str] = []

    def end() -> None:
        line = _SPACES.sub(" ", "".join(parts)).strip()
        parts.clear()
        if line:
            found.append(line)

    for top in tops:
        end()
        waiting: list[Node | str | None] = [top]
        while waiting:
            x = waiting.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                parts.append(x)
            elif x.tag == "br":
                parts.append(" ")
            else:
                if x.tag in BLOCKS:
                    end()
                    waiting.append(None)
                waiting.extend(reversed(x.items))
    end()
    return found


def main_text(page: str | None) -> str:
    """The main text of one page; null, empty and textless pages give an empty string."""
    return "\n".join(blocks(chosen(parse(page)))) if page else ""


def extract(df: DataFrame, page: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``df`` without the page column, with its main text (empty if none) and the text's code points.

    Columns of those names are replaced; others pass unchanged.
    """
    kept = [c for c in df.columns if c not in (page, text, n_chars)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, page):
            texts = [main_text(x) for x in batch.column(page).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*kept, text, n_chars])

    return df.mapInArrow(run, df.select(*kept, F.lit("").alias(text), F.lit(0).cast("long").alias(n_chars)).schema)
