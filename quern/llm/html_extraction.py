"""Main-text extraction by tree scoring.

The page is read into a tree of block elements. Boilerplate elements (by tag,
role, class or id) go with all they hold. Each paragraph of some length gives
points for its length and its commas to its ancestors, halved at each step
up; a container's points are discounted by its share of link text. The best
container is kept. One that an article or main holds is kept as that whole
article or main, whatever its length (of nested articles the outermost), with
other articles beside it that score alike. Where there is none, the siblings
of the best container are kept too, and those of its ancestors below the
body, unless they are mostly links; beside an ancestor in the body itself
headings, paragraphs and what scores or reads like text.

One page at a time, in one pass over its tags, linear in its length however
deep it nests: no exchange, memory bounded by the longest page. Defined
results: a null or empty page, or one without any text, gives an empty text;
of equal containers the first wins; broken markup (unclosed or stray tags,
open comments, stray quotes) is read as far as it goes, and an element
without text of its own that is never closed hides nothing. Extra columns are
left out.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import map_arrow

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # a quoted value may hold anything; a quote anywhere else is a character like others
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]++|=\s*+(?>\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)(?:>|\Z)",
    re.S,
)
_WORDS = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

#: Elements whose content is text up to their end tag, or to the end of the page.
RAW = {"script", "style", "textarea", "title", "iframe", "noframes", "noembed", "xmp"}
#: Elements that go with what they hold up to their end tag; unclosed ones hold nothing.
SKIP = {"noscript", "template", "svg", "math", "object", "select", "button", "canvas", "audio", "video"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption hr br".split()
)
#: Elements that go with all they hold; a header goes unless an article or main holds it.
DROP = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "fieldset", "label"}
_BAD_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "form", "toolbar"}
_BAD_NAME = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|overlay|nav\w*|menu\w*|breadcrumbs?|sidebar|side|"
    r"footer|foot|masthead|comments?|commentlist|disqus|respond|replies|shar(?:e|ing)|social|related|recommend\w*|subscribe|newsletter|signup|login|pagination|pager|toolbar|widget)(?:$|[_-])",
    re.I,
)
#: Names of a layout, not of the element's own place in it.
_LAYOUT_NAME = re.compile(r"^(?:has|with|no|without|is|not)[_-]", re.I)
_GOOD_NAME = re.compile(r"article|body|content|entry|main|post|story|text", re.I)
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
_PARAGRAPH = {"p", "pre", "td", "blockquote", "li", "dd"}
#: A start tag closes the nearest open items of its kind, as far as the list or table that holds them.
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_ITEMS = {"li", "dt", "dd", "tr", "td", "th"}
_LISTS = {"ul", "ol", "dl", "table", "html", "menu", "dir"}
#: Above this share of link text a block is a list of links.
_LINKS = 0.25


class Node:
    __slots__ = ("tag", "parent", "children", "good", "bad", "points", "text", "links", "item")

    def __init__(self, tag: str, parent: Node | None, good: bool = False, bad: bool = False) -> None:
        self.tag, self.parent, self.good, self.bad = tag, parent, good, bad
        self.children: list[Node | str] = []
        self.points, self.text, self.links = 0.0, 0, 0
        #: the nearest open item of a list or table within the nearest list or table
        self.item: Node | None = self if tag in _ITEMS else None if tag in _LISTS or parent is None else parent.item


def _names(attributes: str) -> tuple[bool, bool]:
    """Whether the attributes speak for content, and for boilerplate."""
    good = bad = False
    for key, a, b, c in _WORDS.findall(attributes):
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            names = [x for x in value.split() if not _LAYOUT_NAME.match(x)]
            bad |= any(map(_BAD_NAME.search, names))
            good |= any(map(_GOOD_NAME.search, names))
        elif key == "role":
            bad |= value.lower() in _BAD_ROLE
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            bad = True
    return good, bad


def _ends(page: str, tag: str) -> dict[int, int]:
    """Where each closed element of a kind ends, by the end of its start tag; one that is never closed has no entry."""
    out, opened = {}, []
    for m in re.finditer(rf"<(/?){re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", page, re.I):
        if not m[1]:
            opened.append(m.end())
        elif opened:
            out[opened.pop()] = m.end()
    return out


def parse(page: str) -> Node:
    """The tree of block elements; inline elements leave only their text, and their link text's length."""
    root = top = Node("html", None)
    opened: Counter[str] = Counter()
    ends: dict[str, dict[int, int]] = {}
    link = 0
    at, end = 0, len(page)

    def add(raw: str) -> None:
        if not raw:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        top.children.append(text)
        n = len(text.strip())
        top.text += n
        if link:
            top.links += n

    def close(node: Node) -> Node:
        """Closes all open elements down to `node`; what holds it is open then."""
        x = top
        while x is not node:
            opened[x.tag] -= 1
            x = x.parent
        opened[x.tag] -= 1
        return x.parent

    def skipped(tag: str) -> int | None:
        if tag not in ends:
            ends[tag] = _ends(page, tag)
        return ends[tag].get(at)

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            add(m[0][9:].removesuffix("]]>"))
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = max(0, link - 1)
            elif tag in BLOCK and opened[tag]:
                x = top
                while x.tag != tag:
                    x = x.parent
                top, link = close(x), 0
            continue
        empty = m[3].endswith("/")
        if tag in RAW:
            if not empty:
                stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag in SKIP:
            at = (None if empty else skipped(tag)) or at
            continue
        if tag in ("br", "hr"):
            top.children.append(" ")
            continue
        if tag in VOID:
            continue
        if tag == "a":
            link += 1
            continue
        if tag not in BLOCK:
            if m[3] and not empty and tag in ("span", "ins", "amp-ad") and _names(m[3])[1]:
                at = skipped(tag) or at  # an inline element marked as boilerplate goes up to its end tag
            continue
        if top.tag == "p":  # no block stands in a paragraph
            top, link = close(top), 0
        while tag in _SAME and top.item is not None and top.item.tag in _SAME[tag]:
            top, link = close(top.item), 0
        good, bad = _names(m[3]) if m[3] else (False, False)
        article = tag in ("article", "main")
        bad = bad and not article and tag not in ("html", "body") or tag in DROP or tag == "header" and not (opened["article"] or opened["main"])
        node = Node(tag, top, good or article, bad)
        top.children.append(node)
        if not empty:
            top = node
            opened[tag] += 1
    return root


def _prune(node: Node) -> list[Node]:
    """Takes boilerplate out; the nodes left, parents first."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        out.append(x)
        x.children = [c for c in x.children if isinstance(c, str) or not c.bad]
        stack.extend(c for c in reversed(x.children) if not isinstance(c, str))
    return out


def _blocks(node: Node | str) -> list[str]:
    """Texts of the blocks in page order, white space as one space."""
    out: list[str] = []
    run: list[str] = []
    stack: list = [iter([node])]

    def close() -> None:
        if run:
            if t := " ".join("".join(run).split()):
                out.append(t)
            run.clear()

    while stack:
        c = next(stack[-1], None)
        if c is None:
            stack.pop()
            close()
        elif isinstance(c, str):
            run.append(c)
        else:
            close()
            stack.append(iter(c.children))
    return out


def _score(nodes: list[Node], min_length: int) -> dict[Node, float]:
    """Points of the containers, discounted by links; texts and links of whole elements are summed on the way."""
    for x in reversed(nodes):
        if x.parent is not None:
            x.parent.text += x.text
            x.parent.links += x.links
    for x in nodes:
        own = [c for c in x.children if isinstance(c, str)]
        direct = sum(len(c.strip()) for c in own)
        if direct < min_length:
            continue
        points = 1 + sum(c.count(",") for c in own) + min(direct / 100, 3.0)
        points *= 1 - min(1.0, x.links / max(x.text, 1))
        share, up = 1.0, x.parent if x.tag in _PARAGRAPH and x.parent is not None else x
        while up is not None and share > 1e-9:  # halved away beyond that
            up.points += points * share
            share /= 2
            up = up.parent
    return {x: (x.points + (25 if x.tag in ("article", "main") else 5 if x.good else 0)) * (1 - _density(x)) for x in nodes if x.points}


def _density(x: Node) -> float:
    return min(1.0, x.links / max(x.text, 1))


def _around(best: Node) -> tuple[Node | None, Node | None]:
    """The outermost article and the nearest main that hold a container, or are it."""
    article = main = None
    x: Node | None = best
    while x is not None:
        if x.tag == "article":
            article = x
        elif x.tag == "main":
            main = main or x
        x = x.parent
    return article, main


def extract(page: str | None, min_length: int = 25) -> str:
    """The main text of a page: its blocks joined by one space."""
    if not page:
        return ""
    root = parse(page)
    nodes = _prune(root)
    value = _score(nodes, min_length)
    if not value:
        # nothing reads like a paragraph: the marked container, else all that is left
        marked = [x for x in nodes if x.tag in ("article", "main") and x.text]
        return " ".join(_blocks(max(marked, key=lambda x: x.text) if marked else root))
    best = max(value, key=value.__getitem__)
    least = max(10.0, 0.2 * value[best])
    article, main = _around(best)
    if article is not None and article.parent is not None:
        least = max(10.0, 0.2 * value.get(article, 0.0))
        kept = [c for c in article.parent.children if c is article or isinstance(c, Node) and c.tag == "article" and value.get(c, 0.0) >= least and _density(c) < _LINKS]
        return " ".join(t for c in kept for t in _blocks(c))
    if main is not None:
        return " ".join(_blocks(main))
    inner, before, after = best, [], _blocks(best)  # `before` is last first
    while inner.parent is not None:
        outer = inner.parent
        page_level = outer.tag in ("body", "html")
        ahead: list[str] = []
        side = ahead
        for c in outer.children:
            if c is inner:
                side = after
            elif isinstance(c, str):
                if not page_level or len(c.strip()) >= min_length:
                    side += _blocks(c)
            elif _density(c) < _LINKS and (not page_level or c.tag in _HEADING or c.tag == "p" or value.get(c, 0.0) >= least or c.tag in _PARAGRAPH and c.text >= min_length):
                side += _blocks(c)
        before += reversed(ahead)
        inner = outer
    return " ".join([*reversed(before), *after])


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    url = F.col(url_col) if url_col else F.lit(None)
    d = pages.select(F.col(id_col).alias("page_id"), url.cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(d, run, f"page_id {d.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
