"""HTML extraction by composite text density.

A page is read into a tree that mends what browsers mend (unclosed paragraphs and list items, stray end tags, raw text,
nesting beyond DEPTH).  Parts that say what they are (navigation, forms, adverts, comments, ... by tag, role, class or
id) are left out.  Runs of bare text and inline elements become nodes of their own.  Every node gets a density:
characters for each tag, adjusted by its links,

    C / T * log_base((C / LC) * (T / LT)),  base = ln(C * LC / notLC + C * bodyLC / bodyC + e)

with C characters, T tags, LC and LT those in links.  The node whose children's densities have the largest sum is the
main one; the least density on its path to the body is the threshold.  The text is that node's, with those siblings along
the path whose density reaches the threshold, and bare text along it.  Where the main node lies in an element that the page marks as its article,
the article is taken whole and nothing beside it: there the mark, not the threshold, says where the text ends."""

from __future__ import annotations

import html
import math
from collections.abc import Iterator

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LONG, STRING, schema

# Element and attribute names of HTML, and names that authors give to parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea title template xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
DROPPED = frozenset("script style noscript iframe textarea title template head nav footer aside form button select option input dialog menu svg math object canvas audio video map xmp noembed noframes".split())
CLOSES_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
BAD = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promotion banner sidebar side aside nav navbar navigation menu submenu breadcrumb breadcrumbs footer foot header "
    "masthead topbar cookie cookies consent gdpr privacy notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search form share sharing social widget widgets toolbar "
    "pagination pager related recommended recommendations trending popular teaser teasers copyright legal disclaimer skip hidden".split()
)
TALK = frozenset("comment comments commentlist disqus reply replies respond discussion feedback reviews".split())
GOOD = frozenset("content article post entry main story text body page wrapper container".split())

#: Elements that may be open at once; what would lie deeper stands beside its parent, as in browsers.
DEPTH = 512
_QUOTED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_RAW_END = {tag: re.compile(f"</{tag}(?![a-z0-9])", re.I | re.A) for tag in RAW}
_ZEROS, _HUGE = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])"), re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: The tag of nodes that stand for runs of bare text and inline elements.
RUN = "#run"
_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_HIDE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("article", "attrs", "block", "chars", "density", "kids", "link_chars", "link_tags", "parent", "sum", "tag", "tags")

    def __init__(self, tag: str, attrs: str, parent: Node | None, kids: list | None = None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, [] if kids is None else kids


def unescaped(text: str) -> str:
    """Character references decoded; numbers that no character has, however long, are U+FFFD."""
    if "&#" in text:
        text = _HUGE.sub("\ufffd", _ZEROS.sub(r"&#\1", text))
    return html.unescape(text)


def tokens(page: str) -> Iterator[tuple]:
    """``(text,)`` or ``(tag, ends, attrs)`` in order.  Each character is looked at a bounded number of times."""
    at, last, quoted = 0, page.rfind(">"), True
    text = 0  # where text that isn't given yet begins
    while True:
        lt = page.find("<", at)
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            to = len(page) if end < 0 else end + 3
            yield (page[text:lt],)
            at = text = to
            continue
        if page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt + 9)
            yield (page[text:lt],)
            yield (html.escape(page[lt + 9 : len(page) if end < 0 else end]),)
            at = text = len(page) if end < 0 else end + 3
            continue
        if lt > last:
            break  # no tag ends any more
        if page[lt + 1] in "!?":
            yield (page[text:lt],)
            at = text = page.find(">", lt) + 1
            continue
        m = _QUOTED.match(page, lt) if quoted else None
        if m is None:
            m = _PLAIN.match(page, lt)
            quoted = quoted and m is None  # a quote that nothing ends: from here on a tag ends with the next >
        if m is None:
            at = lt + 1
            continue
        yield (page[text:lt],)
        tag = m[2].lower()
        yield tag, bool(m[1]), m[3]
        at = text = m.end()
        if tag in RAW and not m[1]:
            end = _RAW_END[tag].search(page, at)
            gt = page.find(">", end.end()) if end else -1
            at = text = len(page) if gt < 0 else gt + 1
    yield (page[text:],)


def parse(page: str) -> Node:
    root = top = Node("body", "", None)
    depth: dict[str, int] = {}  # open elements by tag
    level = 0

    def close(to: Node) -> Node:
        nonlocal level
        node = top
        while node is not to:
            depth[node.tag] -= 1
            level -= 1
            node = node.parent
        depth[to.tag] -= 1
        level -= 1
        return to.parent

    def nearest(tag: str, stops) -> Node | None:
        node = top
        while node is not root:
            if node.tag == tag:
                return node
            if node.tag in stops:
                return None
            node = node.parent
        return None

    for token in tokens(page):
        if len(token) == 1:
            if token[0]:
                top.kids.append(token[0])
            continue
        tag, ends, attrs = token
        if tag in ("html", "body"):
            continue
        if ends:
            if depth.get(tag):
                node = top
                while node.tag != tag:
                    if tag in INLINE and node.tag not in INLINE:
                        break  # an inline element doesn't end what lies around it
                    node = node.parent
                else:
                    top = close(node)
            continue
        if tag not in INLINE and depth.get("p") and tag not in VOID | RAW:
            found = nearest("p", ("table", "td", "th", "button", "object"))
            if found is not None:
                top = close(found)
        if tag in CLOSES_SAME and depth.get(tag):
            found = nearest(tag, CLOSES_SAME[tag])
            if found is not None:
                top = close(found)
        if level >= DEPTH:
            top = close(top)
        node = Node(tag, attrs, top)
        top.kids.append(node)
        if tag not in RAW and tag not in VOID:  # <div/> opens a div, as in browsers
            top = node
            depth[tag] = depth.get(tag, 0) + 1
            level += 1
    return root


def _in_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += (k for k in node.kids if isinstance(k, Node))
    return out


def _look_below(root: Node) -> None:
    """Which nodes hold an article or a heading of one, and which are or hold blocks."""
    for node in reversed(_in_order(root)):
        below = [k for k in node.kids if isinstance(k, Node)]
        node.article = any(k.article or k.tag in ("article", "main", "h1") for k in below)
        node.block = node.tag not in INLINE or any(k.block for k in below)


def _says_boilerplate(node: Node, in_article: bool) -> bool:
    if node.tag in DROPPED:
        return True
    if node.tag == "header" and not in_article and not node.article:
        return True
    if not node.attrs:
        return False
    names: set[str] = set()
    for name, *values in _ATTR.findall(node.attrs):
        value, name = next((v for v in values if v), ""), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDE.search(value):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id"):
            names.update(x.lower() for x in _PART.findall(value))
    if names & TALK:
        return not (node.tag == "main" or node.tag == "article" and node.article)
    return bool(names & BAD) and not names & GOOD and node.tag not in ("article", "main", "h1", "p") and not node.article


def _prune(root: Node) -> None:
    """Parts that say what they are go; runs of what isn't a block become nodes."""
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside = inside or node.tag in ("article", "main")
        kids, run = [], None
        for k in node.kids:
            if isinstance(k, Node) and _says_boilerplate(k, inside):
                continue
            if isinstance(k, Node) and k.block or not node.block:
                kids.append(k)
                run = None
                continue
            if run is None:
                run = Node(RUN, "", node)
                run.block = True
                kids.append(run)
            if isinstance(k, Node):
                k.parent = run
            run.kids.append(k)
        node.kids = [k for k in kids if not (isinstance(k, Node) and k.tag == RUN and not any(isinstance(x, Node) or x.strip() for x in k.kids))]
        for k in node.kids:
            if isinstance(k, Node):
                todo += ((x, inside) for x in k.kids if isinstance(x, Node)) if k.tag == RUN else ((k, inside),)


def _weigh(root: Node) -> Node:
    """Densities of all nodes; the node whose children's densities sum up highest."""
    nodes = _in_order(root)
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for k in node.kids:
            if isinstance(k, Node):
                node.chars += k.chars
                node.tags += k.tags + (k.tag != RUN)
                node.link_chars += k.link_chars
                node.link_tags += k.link_tags
            else:
                node.chars += len("".join(unescaped(k).split()))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    share = root.link_chars / max(1, root.chars)
    for node in nodes:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
    best, most = root, -1.0
    for node in nodes:
        node.sum = math.fsum(k.density for k in node.kids if isinstance(k, Node))
        if node.block and node.sum > most:
            best, most = node, node.sum
    return best


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Link-adjusted characters for each tag; ``share``: of the body's characters those in links."""
    if not chars:
        return 0.0
    tags = max(1, tags)
    base = math.log(chars * link_chars / max(1, chars - link_chars) + share * chars + math.e)
    # a text of one character a tag counts a little, not nothing
    return chars / tags * math.log(1 + chars / max(1, link_chars) * tags / max(1, link_tags)) / math.log(base + 1)


def _blocks(node: Node, drop, out: list[str]) -> None:
    """Texts of the blocks below a node, in page order, without those that ``drop`` says."""
    parts: list[str] = []

    def flush():
        if parts:
            text = " ".join(unescaped("".join(parts)).split())
            parts.clear()
            if text:
                out.append(text)

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            parts.append(x)
        elif x.tag == "br":
            parts.append(" ")
        elif x.tag in INLINE:
            todo += reversed(x.kids)
        elif x is node or not drop(x):
            flush()
            todo += [None, *reversed(x.kids)]
    flush()


def main_text(page: str | None) -> str:
    """The article's blocks, joined by line feeds; empty if the page has no text."""
    if not page:
        return ""
    root = parse(page)
    _look_below(root)
    _prune(root)
    best = _weigh(root)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    marked = [n for n in path if n.tag in ("article", "main")]
    out: list[str] = []
    if marked:
        _blocks(next((n for n in reversed(marked) if n.tag == "article"), marked[-1]), lambda _: False, out)
        return "\n".join(out)
    on_path = set(map(id, path))
    todo = [root]
    while todo:
        node = todo.pop()
        if node is best or id(node) not in on_path:
            _blocks(node, lambda x: x.link_tags >= 2 and x.link_chars > 0.6 * x.chars and x.density < threshold, out)
            continue
        for k in reversed(node.kids):
            # along the path, what reaches the threshold stands beside the main node, and bare text, which no tag sets apart
            if isinstance(k, Node) and (id(k) in on_path or (k.tag == RUN or k.density >= threshold) and k.link_chars <= 0.3 * k.chars):
                todo.append(k)
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages`` (columns ``page_id, url, html``; others are ignored).

    Null or blank html gives an empty text; ids and urls stay as they are, null too; repeated rows each give a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, schema(page_id=LONG, url=STRING, text=STRING, n_chars=LONG))
