"""Main text of a page by composite text density.

For every node of the page's tree: characters C, tags T, link characters LC and link tags LT of its subtree give the
density C / T * log_b(C / LC' * T / LT'), whose base b = ln(C / notLC * LC + LCb / Cb * C + e) is link-adjusted by the
node and the body b. The density sum of a node is the sum of its children's densities. The node with the greatest
density sum is found; the least density on its path to the body is the threshold, and from the body down, nodes below
the threshold are left and of the others the subtree with the greatest density sum is taken as the main content, with the
elements beside it that reach the threshold too. From there the text is written block by block.

Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles are no content wherever they
stand: their elements are left out by name, role, class or id before densities are taken. A form or an element marked by
role, class or id stays if it is round the article: if no article or main stands outside marked elements, and it holds one
or most of the page's text outside links.

Defined results: a null page and a page without text give an empty text; unclosed and stray tags are closed or passed
over as browsers do for paragraphs and list items; a br is white space; repeated rows each keep a row; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
#: Elements by what they mean in HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
APART = frozenset("nav header footer aside form button select dialog menu head noscript template iframe svg math object canvas audio video".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS
#: Words in class, id or role that mark what is not the article.
MARKS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|header|footer|sidebar|side|aside|comments?|disqus|reply|replies|respond|cookies?|consent|notice|popup|modal|newsletter|subscribe|social|share|sharing|related|recommend\w*|widget|toolbar|pagination|pager|search|login|signup|contentinfo|complementary|navigation|alert|dialog)(?:$|[\s_-])", re.I)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|reply|replies)(?:$|[\s_-])", re.I)
KEPT = frozenset(("html", "body", "article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
#: The head of an article by its name is part of it.
OWN_HEAD = re.compile(r"(?:article|entry|post|content|story)[_-]+header", re.I)


class Node:
    __slots__ = ("name", "parts", "parent", "out", "marked", "holds", "plain", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, name: str, parent: Node | None, out: bool):
        self.name, self.parent, self.out, self.parts = name, parent, out, []
        self.marked = self.holds = False
        self.plain = 0
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def _marked(name: str, attributes: str) -> bool:
    if name == "form":
        return True
    if name in ("html", "body") or not attributes:
        return False
    marks = COMMENTS if name in KEPT else MARKS  # an article is left out only as a reader's comment
    return any(marks.search(OWN_HEAD.sub("", m[1].strip("\"'"))) for m in _NAMED.finditer(attributes))


def parse(page: str) -> Node:
    """The tree of a page; parts of a node are its texts and child nodes in order."""
    root = here = Node("html", None, False)
    at, n = 0, len(page)
    opened: dict[str, int] = {}  # how many of a name stand open, so that a stray closing tag costs no walk

    def close(down_to: Node) -> None:
        nonlocal here
        while here is not down_to:
            opened[here.name] -= 1
            here = here.parent

    while at < n:
        m = _TOKEN.search(page, at)
        begin = m.start() if m else n
        if begin > at:
            here.parts.append(page[at:begin])
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if not opened.get(name):
                continue
            up = here
            while up is not root and up.name != name:
                if up.name in ("td", "th", "table", "article", "body") and name not in BLOCKS:
                    up = root
                    break
                up = up.parent
            if up is not root:
                close(up.parent)
            continue
        if name == "html":
            continue
        if name in CLOSES_P and opened.get("p"):  # a block ends an open paragraph, and whatever is open in it
            up = here
            while up is not root and up.name != "p" and (up.name not in BLOCKS):
                up = up.parent
            if up is not root and up.name == "p":
                close(up.parent)
        if name in ("li", "dt", "dd", "tr", "td", "th", "option") and opened.get(name):
            up = here
            while up is not root and up.name != name and up.name not in ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select") and not (name != "tr" and up.name == "tr"):
                up = up.parent
            if up is not root and up.name == name:
                close(up.parent)
        child = Node(name, here, here.out or (name in APART and name != "form"))
        child.marked = not child.out and _marked(name, m[3])
        here.parts.append(child)
        if name in ("svg", "math") and m[3].endswith("/"):  # foreign elements may close themselves
            continue
        if name in RAW:
            child.out = True
            end = re.compile(rf"</{name}\s*>|\Z", re.I).search(page, at)
            at = end.end()
        elif name not in VOID and not m[3].endswith("/"):
            here = child
            opened[name] = opened.get(name, 0) + 1
    leave_out(root)
    return root


def leave_out(root: Node) -> None:
    """Marks the marked elements as out, but for those round the article.

    Where an article or main stands outside all marked elements, they all go. Else one that holds an article, a main or most
    of the page's text outside links is opened, and the marked elements in it are judged in the same way.
    """
    for node in reversed(_order(root)):
        node.holds = node.name in ("article", "main") and not node.marked
        for x in node.parts:
            if isinstance(x, str):
                node.plain += len("".join(x.split()))
            elif not x.out:
                node.holds |= x.holds
                node.plain += x.plain
        if node.name == "a":
            node.plain = 0
    scopes = [root]
    while scopes:
        todo, found, free = [scopes.pop()], [], False
        while todo:
            node = todo.pop()
            free |= node.name in ("article", "main") and not node.marked
            for x in node.parts:
                if isinstance(x, Node) and not x.out:
                    (found if x.marked else todo).append(x)
        for x in found:
            if not free and (x.holds or 2 * x.plain > root.plain):
                scopes.append(x)
            else:
                x.out = True


def _order(root: Node) -> list[Node]:
    """Nodes that may be content, parents first."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        found.append(node)
        todo.extend(x for x in node.parts if isinstance(x, Node) and not x.out)
    return found


def measure(root: Node) -> list[Node]:
    nodes = _order(root)
    for node in reversed(nodes):
        link = node.name == "a"
        for x in node.parts:
            if isinstance(x, Node):
                if x.out:
                    continue
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.name == "a")
            else:
                node.chars += len(x) - x.count(" ") if not x.isspace() else 0
        if link:
            node.link_chars = node.chars
    body = next((x for x in nodes if x.name == "body"), root)
    share = body.link_chars / max(body.chars, 1)
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, max(node.link_tags, 1)
        if c:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            node.density = c / t * math.log(c / max(lc, 1) * t / lt) / math.log(max(base, 1.5))  # 1.5: a page without links
    for node in nodes:
        node.sum = sum(x.density for x in node.parts if isinstance(x, Node) and not x.out)
    return nodes


def main_content(root: Node) -> Node:
    nodes = measure(root)
    best = max(nodes, key=lambda x: x.sum)
    path, up = [], best
    while up is not None:
        path.append(up)
        if up.name == "body":
            break
        up = up.parent
    threshold = min(x.density for x in path)
    top = path[-1]
    kept, todo = [], [top]
    while todo:
        node = todo.pop()
        kept.append(node)
        todo.extend(x for x in node.parts if isinstance(x, Node) and not x.out and x.density >= threshold)
    chosen = max(kept, key=lambda x: x.sum)
    if chosen.sum <= 0:
        return top
    return widened(chosen, threshold)


def widened(chosen: Node, threshold: float) -> Node:
    """The chosen subtree with what belongs to it beside it. In an article it is the article. Else, going up, elements at least
    as dense as the threshold come along, sections beside a section, and headings right before it; the other elements there are left out, and nothing
    beyond the first parent that has none to bring along."""
    up = chosen
    while up is not None:
        if up.name == "article":
            return up
        up = up.parent
    while chosen.name not in KEPT and chosen.parent is not None and chosen.parent.name not in ("body", "html"):
        beside = [x for x in chosen.parent.parts if isinstance(x, Node) and not x.out]
        place = beside.index(chosen)
        dense = {id(x) for x in beside if x is not chosen and x.chars > x.link_chars and (x.density >= threshold or x.name == chosen.name == "section")}
        for x in reversed(beside[:place]):
            if x.name not in HEADINGS:
                break
            dense.add(id(x))
        others = [x for x in beside if x is not chosen and id(x) not in dense and x.chars]
        if not dense and (others or any(isinstance(x, str) and not x.isspace() for x in chosen.parent.parts)):
            break
        for x in others:
            x.out = True
        chosen = chosen.parent
    return chosen


def blocks(node: Node) -> list[str]:
    """The texts of a subtree's blocks in page order."""
    lines: list[list[str]] = [[]]
    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            if lines[-1]:
                lines.append([])
        elif isinstance(x, str):
            lines[-1].append(x)
        elif not x.out:
            if x.name == "br":
                lines[-1].append(" ")
                continue
            if x.name in BLOCKS:
                if lines[-1]:
                    lines.append([])
                todo.append(None)
            todo.extend(reversed(x.parts))
    return [y for y in (" ".join(html.unescape("".join(x)).split()) for x in lines) if y]


def extract(page: str | None) -> str:
    """The main text of one page."""
    return "\n".join(blocks(main_content(parse(page)))) if page else ""


def with_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def of(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(of, "page_id long, url string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return with_text(table(spark, sf_dir, "pages"))
