"""HTML main-text extraction by composite text density.

A page becomes a DOM (void elements, implied ends of ``p``, ``li`` and table
parts, raw text of scripts).  Elements that are no article by their tag, class,
id or role (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments, …) are cut out.  A class or id counts by its head word: ``cookie-banner``,
``sidebar-left`` and ``comments-area`` name such a part, while ``no-sidebar``,
``menu-open``, ``has-comments`` or ``layout--sidebar`` tell the state of a wrapper and
``post-header`` the head of the article.  A header inside ``article`` or ``main``
belongs to it, and an element that holds ``main`` is never cut by its name.
Then for every node:

* *density*: characters per tag, adjusted for links,
  ``C/T * log_b(C/LC * T/LT)`` with ``b = ln(C/(C-LC) * LC + LCb/Cb * C + e)``
  (C, T: characters and tags below the node; LC, LT: those inside links; Cb, LCb:
  the body's);
* *density sum*: the sum of its children's densities.  Inline elements (``b``,
  ``span``, …) without blocks in them are part of the text around them and add none.

The node with the largest density sum gives the *threshold*: the least density
on its path to the body.  From the body down, each node whose density reaches
the threshold contributes its subtree's largest-sum node to the text; on the
path, an ``article`` or ``main`` stands for what lies in it.  The last ``h1`` before the
text that is not just a link is its title and is kept with it.

The kept text is cut into blocks (paragraphs, headings, list items, rows, …);
character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined by one newline in page order.

Each page is handled by itself, in time proportional to its length.

Defined cases: null or empty html and pages without text give an empty string;
unclosed and stray tags are tolerated; repeated rows each give their own result;
input columns are kept, a column named like the result is replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from solstice.llm import words as W

# HTML's element classes and names that mark parts which are no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
ENDS_P = BLOCKS - {"body", "html", "caption", "tbody", "tfoot", "thead", "tr"}
CUT_TAGS = RAW | frozenset("head nav header footer aside form button select option input svg canvas object embed menu dialog audio video".split())
CUT_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert "
                      "popup modal overlay newsletter subscribe signup login sidebar sidenav widget widgets related recommended recommendations share sharing social "
                      "breadcrumb breadcrumbs nav navigation navbar menu menubar footer header masthead topbar toolbar pagination pager comment comments respond "
                      "disqus replies reply skip search searchbox".split())
CUT_NAMES |= frozenset("adsbygoogle skyscraper leaderboard".split())
# Words of a class or id: states of a wrapper, what holds a part, and whose header is the article's own.
STATES = frozenset("no not non has have with without is are js hide show can layout".split())
HOLDERS = frozenset("box wrap wrapper container area section block inner outer list item items unit slot group row col column columns content left right top bottom bar panel zone "
                    "region holder form title heading text post posts article articles stories story link links button buttons icon icons card cards primary secondary main "
                    "desktop mobile body module strip".split())
OWN = frozenset("post entry article content page story section title".split())
HEADS = frozenset("header masthead".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WHOLE = frozenset(["html", "body", "main"])
CLOSERS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}), "thead": ({"tbody"}, {"table"})}

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME = re.compile(r"[a-z]+|[0-9]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z][a-z])")


class Node:
    __slots__ = ("tag", "parent", "children", "cut", "within", "inline", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, cut: int):
        self.tag, self.parent, self.cut = tag, parent, cut
        self.within = tag in ("article", "main") or parent is not None and parent.within
        self.inline = tag in INLINE
        self.children: list = []  # nodes and strings
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def names_a_cut(name: str, within: bool) -> bool:
    """Whether one class or id names a part that is no article; ``within``: inside ``article`` or ``main``."""
    words = _NAME.findall(_HUMP.sub("-", name.split("--")[0]).lower())
    if not words or words[0] in STATES:
        return False
    whole = "".join(words)
    k = len(words)
    while k and words[k - 1] not in CUT_NAMES and (words[k - 1] in HOLDERS or words[k - 1].isdigit()):
        k -= 1
    head = whole if whole in CUT_NAMES else words[k - 1] if k and words[k - 1] in CUT_NAMES else ""
    if head in HEADS:
        return not within and not OWN & set(words[: k - 1])
    if head == "sidebar" and words[0] == "content":  # a wrapper of both
        return False
    return head != ""


def _is_cut(tag: str, attributes: str, within: bool) -> int:
    """2: cut by its tag or role, 1: by a class or id, 0: not."""
    if tag in CUT_TAGS:
        return 0 if tag == "header" and within else 2
    if not attributes or tag in WHOLE:
        return 0
    by_name = 0
    for kind, *values in _ATTRIBUTE.findall(attributes):
        names = _html.unescape("".join(values)).split()
        if kind.lower() == "role":
            if any(x.lower() in CUT_ROLES and not (within and x.lower() == "banner") for x in names):
                return 2
        elif any(names_a_cut(x, within) for x in names):
            by_name = 1
    return by_name


def parse(html: str) -> Node:
    """The DOM of a page; text inside elements cut by their tag is left out."""
    root = Node("html", None, 0)
    at, pos, n = root, 0, len(html)
    opened: Counter = Counter()  # open elements by tag: a stray end costs no walk

    def text(a: int, z: int) -> None:
        if z > a and at.cut < 2:
            at.children.append(_html.unescape(html[a:z]))

    def leave(x: Node) -> None:
        """Ends ``x`` and all that is open in it."""
        nonlocal at
        while at is not x:
            opened[at.tag] -= 1
            at = at.parent
        opened[x.tag] -= 1
        at = x.parent

    def close(tags: set | frozenset, within: set | frozenset) -> None:
        """Ends the nearest open element of ``tags`` unless one of ``within`` encloses it more closely."""
        if not any(opened[t] > 0 for t in tags):
            return
        x = at
        while x is not root and x.tag not in within:
            if x.tag in tags:
                leave(x)
                return
            x = x.parent

    while pos < n:
        m = _MARKUP.search(html, pos)
        if m is None:
            text(pos, n)
            break
        text(pos, m.start())
        pos = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if opened[tag] > 0:
                x = at
                while x.tag != tag:
                    x = x.parent
                leave(x)
            continue
        if tag in ("html", "body"):
            if tag == "body":
                at = root
                opened.clear()
            continue
        if tag in ENDS_P:
            close({"p"}, {"button", "td", "th", "table", "li", "article", "section", "div", "blockquote", "main", "aside", "form"})
        if tag in CLOSERS:
            close(*CLOSERS[tag])
            if tag == "tr":
                close({"tr"}, {"table"})
        node = Node(tag, at, max(at.cut, 0 if at.cut == 2 else _is_cut(tag, m.group(3), at.within)))
        if at.cut < 2:
            at.children.append(node)
        if tag == "main":  # what holds the main part isn't cut by its name
            x = node
            while x is not None and x.cut == 1:
                x.cut = 0
                x = x.parent
        if tag in VOID or m.group(3).endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, pos)
            pos = end.end() if end else n
            continue
        at = node
        opened[tag] += 1
    return root


def _nodes(root: Node) -> list[Node]:
    """All nodes that are not cut out, parents first."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack += [c for c in reversed(x.children) if not isinstance(c, str) and not c.cut]
    return out


def measure(root: Node) -> list[Node]:
    """Fills in counts, densities and density sums; returns the nodes, parents first."""
    nodes = _nodes(root)
    for x in reversed(nodes):
        link = x.tag == "a"
        for c in x.children:
            if isinstance(c, str):
                x.chars += len("".join(c.split()))
            elif not c.cut:
                x.chars += c.chars
                x.tags += c.tags + 1
                x.link_chars += c.link_chars
                x.link_tags += c.link_tags + (c.tag == "a")
                x.inline = x.inline and c.inline
        if link:
            x.link_chars = x.chars
    share = root.link_chars / max(root.chars, 1)
    for x in reversed(nodes):
        c, t, lc, lt = x.chars, max(x.tags, 1), max(x.link_chars, 1), max(x.link_tags, 1)
        if c:
            base = max(math.log(c / max(c - x.link_chars, 1) * x.link_chars + share * c + math.e), 1.1)
            x.density = c / t * max(math.log(max(c / lc * t / lt, 1.0)), 0.0) / math.log(base)
        x.total = sum(k.density for k in x.children if not isinstance(k, str) and not k.cut and not k.inline)
    return nodes


def _path(node: Node) -> list[Node]:
    out = [node]
    while out[-1].parent is not None:
        out.append(out[-1].parent)
    return out


def content(root: Node) -> list[Node]:
    """The subtrees that hold the main text, in page order."""
    nodes = measure(root)
    place = {id(x): i for i, x in enumerate(nodes)}
    most = max(nodes, key=lambda x: (x.total, x.chars, -place[id(x)]))
    if most.total <= 0:  # no element holds text: what stands in the body itself
        most = root
    way = _path(most)
    threshold = min((x.density for x in way[:-1]), default=root.density)
    best: dict[int, Node] = {}  # the largest-sum node of each subtree
    for x in reversed(nodes):
        own = [best[id(c)] for c in x.children if not isinstance(c, str) and not c.cut]
        best[id(x)] = max([x, *own], key=lambda y: (y.total, y.chars, -place[id(y)]))
    marked = {id(most)}
    for x in nodes:
        if x is not root and x.density >= threshold > 0:
            marked.add(id(best[id(x)]) if best[id(x)].total > 0 else id(x))
    whole: dict[int, Node] = {}  # the outermost article or main around each node, or itself
    for x in nodes:
        up = whole[id(x.parent)] if x.parent is not None else x
        whole[id(x)] = up if up.tag in ("article", "main") else x
    chosen = {id(whole[id(x)]) for x in nodes if id(x) in marked}
    first = min(place[x] for x in chosen)
    title = next((x for x in reversed(nodes[:first]) if x.tag == "h1" and x.chars > x.link_chars), None)
    if title is not None:
        chosen.add(id(title))
    out, inside = [], set()
    for x in nodes:  # parents first
        if x.parent is not None and id(x.parent) in inside:
            inside.add(id(x))
        elif id(x) in chosen:
            inside.add(id(x))
            out.append(x)
    return out


def _blocks(node: Node, out: list[list[str]]) -> None:
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out[-1].append(x)
        elif x is None:
            out.append([])
        elif not x.cut:
            if x.tag in ("br", "td", "th", "img", "wbr"):
                out[-1].append("" if x.tag == "wbr" else " ")
            apart = x.tag in BLOCKS
            if apart:
                out.append([])
                stack.append(None)
            stack += reversed(x.children)


def extract(html: str | None) -> str:
    """Main text of one page."""
    if not html:
        return ""
    lines: list[list[str]] = [[]]
    for node in content(parse(html)):
        lines.append([])
        _blocks(node, lines)
    joined = (" ".join("".join(parts).split()) for parts in lines)
    return "\n".join(x for x in joined if x)


def with_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Every row with ``text_col``: the main text of ``html_col``."""
    names = [c for c in pages.columns if c != text_col]
    fields = [f for f in pages.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in W.slices(whole, html_col):
                texts = pa.array([extract(h) for h in b.column(html_col).to_pylist()], pa.string())
                yield pa.record_batch([*[b.column(c) for c in names], texts], names=[*names, text_col])

    return pages.mapInArrow(run, T.StructType([*fields, T.StructField(text_col, T.StringType())]))
