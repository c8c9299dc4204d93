"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing and threshold clusters.

The events of the standard library's HTML parser are streamed into lines: a block element or a line break ends a line,
inline elements don't. A line knows its text, its tags, how much of its text is in links, and the elements it lies in.
Lines inside elements that never are main text (navigation, forms, scripts, page headers and footers, or a class, id or
role that says advert, notice, comments and the like) are set aside. A name, or being a form, doesn't set an element
aside that holds the only article, or without articles MOSTLY of the page's text: that is a layout's wrapper.

The text-to-tag ratios of the others, without their link text, are smoothed with a Gaussian, and the lines above THRESHOLD
times the mean form clusters. If the heaviest cluster lies in an article, the region is every outermost article with a line
of a cluster, so that several stay, and what main holds beside an article; else it is the smallest element that holds the
text of all clusters. All lines of the region stay, short ones too, but for lists of links: lines that are mostly links and
are items, cells or beside another such line. Inside an inner article these stay as well.

Work grows with the page, not with the square of its depth: elements keep what close tags look for. Null and empty pages,
and pages without any text outside what is set aside, give an empty text. Rows are extracted one by one: repeated rows,
null ids and an empty table are nothing special.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .runtime import map_text

SIGMA = 1.0
RADIUS = 2
THRESHOLD = 0.5
MOSTLY = 0.75

# Element names of HTML, and words that name what isn't main text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
NEVER = set("head title script style noscript template nav aside button select option textarea iframe object svg canvas audio video menu dialog".split())
ARTICLE = {"article", "main"}
UNCLOSED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSABLE = set().union(*UNCLOSED.values())
STOPS = set("ul ol dl table select article section div body".split())
STOPS_P = set("td th div section article body li blockquote".split())
ENDS_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
NAMED = set(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr masthead menu modal nav navbar "
    "navigation newsletter notice notices overlay pagination popup promo promoted promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe "
    "toolbar widget widgets".split()
)
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WITH = {"has", "no", "with", "without"}
_WORDS = re.compile(r"[A-Za-z]+")


def names_aside(token: str) -> bool:
    """Whether a word of a class or id names what isn't main text, and not what a layout has or lacks."""
    words = _WORDS.findall(token.lower())
    return bool(words) and words[0] not in WITH and not NAMED.isdisjoint(words)


class Node:
    """An element that is open or was: what it lies in, whether it is set aside by name, and whether it or what it lies
    in is set aside for good. open_p and closable are the open elements that a start tag may end, by tag."""

    __slots__ = ("article", "closable", "depth", "named", "never", "open_p", "parent", "scope", "tag")

    def __init__(self, tag: str, parent: Node | None, never: bool, named: bool):
        self.tag, self.parent, self.named = tag, parent, named
        self.depth = parent.depth + 1 if parent else 0
        self.never = never or bool(parent and parent.never)
        self.article = self if tag in ARTICLE else parent.article if parent else None
        # How often each tag is open since the innermost article or body.
        self.scope: dict[str, int] = parent.scope if parent and tag not in ("article", "body") else {}
        self.open_p: Node | None = self if tag == "p" else None if not parent or tag in STOPS_P else parent.open_p
        self.closable: dict[str, Node] = {} if not parent or tag in STOPS else parent.closable
        if tag in CLOSABLE:
            self.closable = self.closable | {tag: self}


class Lines(HTMLParser):
    """Collects lines as [pieces of text, characters in links, tags, node]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.node = Node("", None, False, False)
        self.lines: list[list] = []
        self.links = 0
        self.open: dict[str, int] = {}
        self.fresh()

    def fresh(self) -> None:
        self.line = [[], 0, 0, None]

    def end_line(self) -> None:
        if self.line[3] is not None:
            self.lines.append(self.line)
            self.fresh()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.line[2] += 1
        if tag not in INLINE:
            self.end_line()
        if tag in VOID:
            return
        if tag in ENDS_P and self.node.open_p:
            self.leave(self.node.open_p)
        if inner := [self.node.closable[t] for t in UNCLOSED.get(tag, ()) if t in self.node.closable]:
            self.leave(max(inner, key=lambda n: n.depth))
        self.links += tag == "a"
        self.node = Node(tag, self.node, *self.set_aside(tag, attrs))
        self.count(self.node, 1)

    def count(self, node: Node, by: int) -> None:
        for counts in (self.open, node.scope):
            counts[node.tag] = counts.get(node.tag, 0) + by

    def leave(self, node: Node) -> None:
        inner = self.node
        while inner is not node.parent:
            self.links -= inner.tag == "a"
            self.count(inner, -1)
            inner = inner.parent
        self.node = node.parent

    def set_aside(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
        """Whether an element is set aside for good, and whether by a name that a wrapper of the page may have too."""
        named = tag == "form"
        if tag in NEVER:
            return True, False
        if tag in ("header", "footer"):  # an article's own header has its title, but a footer is none of its text
            return tag == "footer" or self.node.article is None, False
        for name, value in attrs:
            if name in ("hidden", "inert") or (name == "aria-hidden" and value == "true"):
                return True, False
            if value and name in ("class", "id") and tag not in ("html", "body", "main"):
                named = named or any(names_aside(token) for token in value.split())
            if value and name == "role" and value.strip().lower() in ROLES:
                if value.strip().lower() != "form":
                    return True, False
                named = True
            if value and name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, False
        return False, named

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.end_line()
        # An end tag of what isn't open, or is only around the article or body, ends nothing.
        if (self.node.scope if tag in INLINE or tag in ("p", "li") else self.open).get(tag, 0) > 0:
            node = self.node
            while node.tag != tag:
                node = node.parent
            self.leave(node)

    def handle_data(self, data: str) -> None:
        if self.line[3] is None:
            if not data or data.isspace():
                return
            self.line[3] = self.node
        self.line[0].append(data)
        if self.links:
            self.line[1] += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    """Each ratio averaged with its neighbours by Gaussian weights; at the ends over those that there are."""
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(ratios, weights, "full")[radius : radius + len(ratios)] / np.convolve(np.ones(len(ratios)), weights, "full")[radius : radius + len(ratios)]


def main_text(html: str) -> str:
    """The text of a page's content region: its lines, white space in each as one space, joined by line breaks."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    rows = [(" ".join("".join(pieces).split()), links, tags, node) for pieces, links, tags, node in parser.lines if not node.never]
    rows = not_aside([r for r in rows if r[0]])
    if not rows:
        return ""
    ratios = smoothed(np.array([max(0, len(t) - links) / max(1, tags) for t, links, tags, _ in rows]))
    above = ratios > THRESHOLD * ratios.mean()
    regions = regions_of(rows, heaviest(rows, above), above)
    kept = inherited({r[3] for r in rows}, lambda n, over: over or n in regions)
    rows = [r for r in rows if kept[r[3]]]
    listed = [2 * links > len(t) for t, links, _, _ in rows]
    beside = [a or z for a, z in zip([False, *listed], [*listed[1:], False], strict=False)]
    stays = [not link or len(rows) == 1 or r[3].article is not None and r[3].article.tag == "article" or not (near or items(r[3])) for r, link, near in zip(rows, listed, beside, strict=True)]
    return "\n".join(r[0] for r, yes in zip(rows, stays, strict=True) if yes)


def items(node: Node) -> bool:
    """Whether an element is an item or cell, or an inline element in one."""
    while node.parent and node.tag in INLINE:
        node = node.parent
    return node.tag in ("li", "dd", "dt", "td", "th")


def inherited(nodes: Iterable[Node], rule: Callable[[Node, object], object], start: object = False) -> dict[Node, object]:
    """rule(element, what it gave for the parent) for all elements and those around them, each worked out once."""
    known: dict[Node, object] = {}
    for node in nodes:
        path = []
        while node is not None and node not in known:
            path.append(node)
            node = node.parent
        value = known[node] if node is not None else start
        for node in reversed(path):
            known[node] = value = rule(node, value)
    return known


def gathered(weights: dict[Node, int]) -> dict[Node, int]:
    """For all elements and those around them, the weights inside them added up."""
    total = dict.fromkeys(inherited(weights, lambda n, _: None), 0)
    for node, weight in weights.items():
        total[node] += weight
    for node in sorted(total, key=lambda n: -n.depth):
        if node.parent is not None:
            total[node.parent] += total[node]
    return total


def not_aside(rows: list[tuple]) -> list[tuple]:
    """The lines that no name sets aside."""
    free = inherited({r[3] for r in rows}, lambda n, over: over and not n.named, True)
    if all(free[r[3]] for r in rows):
        return rows
    own: dict[Node, int] = {}
    for text, links, _, node in rows:
        own[node] = own.get(node, 0) + max(0, len(text) - links)
    weights = gathered(own)
    articles = [n for n in weights if n.tag in ARTICLE]
    if articles:
        wrappers = set()
        if not any(free[a] and weights[a] for a in articles):
            node = max(articles, key=lambda a: (weights[a], -a.depth))
            while node is not None:
                wrappers.add(node)
                node = node.parent
    else:
        most = MOSTLY * max(weights.values())
        wrappers = {n for n in weights if n.named and weights[n] >= most}
    stays = inherited({r[3] for r in rows}, lambda n, over: over and (not n.named or n in wrappers), True)
    return [r for r in rows if stays[r[3]]]


def heaviest(rows: list[tuple], above: np.ndarray) -> list[int]:
    """The run of lines above the threshold that has most text outside links."""
    best, run, most = list(range(len(rows))), [], 0
    for i, yes in enumerate([*above.tolist(), False]):
        if yes:
            run.append(i)
        elif run:
            if (weight := sum(len(rows[j][0]) - rows[j][1] for j in run)) > most:
                best, most = run, weight
            run = []
    return best


def regions_of(rows: list[tuple], cluster: list[int], above: np.ndarray) -> set[Node]:
    """The outermost articles with a line above the threshold, if the cluster lies in one; or else the innermost element
    that holds all lines above it (of one line, what the line lies in)."""
    outermost = inherited({r[3] for r in rows}, lambda n, over: over or (n if n.tag in ARTICLE else None), None)
    weights: dict[Node | None, int] = {}
    for i in cluster:
        weights[outermost[rows[i][3]]] = weights.get(outermost[rows[i][3]], 0) + len(rows[i][0])
    high = np.flatnonzero(above).tolist() or cluster
    if max(weights, key=weights.get) is not None:
        return {outermost[rows[i][3]] for i in high} - {None}
    counts: dict[Node, int] = {}
    for i in high:
        counts[rows[i][3]] = counts.get(rows[i][3], 0) + 1
    around = [n for n, held in gathered(counts).items() if held == len(high)]
    common = max(around, key=lambda n: n.depth)
    return {common.parent if len(counts) == 1 and common.parent else common}


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep columns, text and n_chars (its code points)."""
    made = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def block(htmls: list[bytes | None]) -> dict:
        texts = [main_text(x.decode("utf-8", "replace")) if x else "" for x in htmls]
        return {"text": texts, "n_chars": np.fromiter(map(len, texts), np.int64, len(texts))}

    return map_text(pages, html, list(keep), made, lambda: block)
