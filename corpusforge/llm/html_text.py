"""Main text of web pages by composite text density.

Every DOM node gets a density: its characters per tag, lowered as links hold more of it. A node's density sum is that of its
children, or its own density if there is no block in it; the node with the largest sum is the core of the page, and the least density on its path to the body is the
threshold. From the body downwards, each node at or above the threshold marks the largest-sum subtree in it as content.
Parts that are never shown, and parts whose tag, role or whole name says that they are no article, count for nothing and are left
out; what such a word also names (a form around a page, a heading's anchor, one word of a longer name) is not.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import small_batches, tidy

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
_ATTR = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are never shown as text, or are controls.
UNSEEN = frozenset("script style noscript button select option textarea input label fieldset iframe object embed applet canvas svg template dialog menuitem title head".split())
#: Elements that stand beside an article, and those of them that may stand around one.
BESIDE = frozenset("nav footer aside form menu header".split())
AROUND = frozenset(("form", "header", "menu"))
#: Roles of such parts.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words that name such a part in a class or id.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disclaimer disqus footer form gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notification overlay pagination popup promo promotion recommended related rail search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget alert contentinfo complementary replies reply respond".split()
)
#: Those of them that also name frames around an article, after what else is in them.
FRAME_WORDS = frozenset("banner footer form header hidden masthead menu modal nav navbar navigation notice overlay rail search sidebar sidebars toolbar topbar widget".split())
#: Words that may stand beside them in such a name; any other word makes it the name of something else (social-policy, related-work).
PLAIN_WORDS = frozenset(
    "site page post blog global main primary secondary top bottom left right upper lower first last sticky fixed mobile desktop container wrapper wrap wrappers box boxes block blocks area section sections region zone panel inner outer bar bars list lists item items group holder row col column slot unit body thread form button buttons link links icon icons text title heading head div module component posts articles stories".split()
)
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that begin and end a block of text; br and table cells are white space in one.
BLOCK = frozenset("address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
SPACED = frozenset(("br", "td", "th", "wbr", "img"))
#: What an opening tag ends.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "body": ("html",)}


class _Node:
    __slots__ = ("tag", "parent", "children", "noise", "chars", "tags", "link_chars", "link_tags", "density", "sum", "mark", "whole")

    def __init__(self, tag: str, parent: _Node | None, noise: int) -> None:
        self.tag, self.parent, self.noise = tag, parent, noise
        self.children: list[_Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.mark = False
        self.whole = tag not in BLOCK and tag not in ("td", "th")  # an inline element: it stands in a block


def _named(value: str) -> frozenset[str]:
    """The noise words of a class or id, as far as one of its names consists of such words and plain ones."""
    found: set[str] = set()
    for name in value.split():
        words = {w.lower() for w in _NAME.findall(name)}
        if words and words <= NOISE_WORDS | PLAIN_WORDS:
            found |= words & NOISE_WORDS
    return frozenset(found)


def _is_noise(tag: str, attributes: str, parent: _Node) -> int:
    """3 if the element is never shown, 2 if it stands beside an article, 1 if it may also stand around one, else 0."""
    if tag in UNSEEN:
        return 3
    kind = 0
    if tag in BESIDE and not (tag == "header" and _within(parent, "article", "section", "main")):
        kind = 1 if tag in AROUND else 2
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return 3
        if tag in ("html", "body", "article", "main"):
            continue
        if name == "role" and ROLES.intersection(value.lower().split()):
            kind = max(kind, 1)
        elif (name == "class" or name == "id" and tag not in _HEADINGS) and (found := _named(value)):
            kind = max(kind, 1 if found <= FRAME_WORDS else 2)
    return kind


def _settle(nodes: list[_Node]) -> None:
    """Hands noise down. What may stand around an article does so if it holds the page's article or first heading, or half of its
    text and more; then its name and tag don't count."""
    around, heading = set(), False
    for node in nodes:
        if node.tag in ("article", "main") or node.tag == "h1" and not heading:
            heading = heading or node.tag == "h1"
            up = node.parent
            while up is not None and up not in around:
                around.add(up)
                up = up.parent
    size = {}
    for node in reversed(nodes):  # children come after their parents
        size[node] = 0 if node.noise == 3 else sum(len(x.strip()) if isinstance(x, str) else size[x] for x in node.children)
    for node in nodes:
        if node.noise == 1 and (node in around or size[node] and 2 * size[node] >= size[nodes[0]]) and node.tag != "header":
            node.noise = 0
        if node.parent is not None and node.parent.noise:
            node.noise = 3


def _within(node: _Node | None, *tags: str) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def _tree(page: str) -> tuple[_Node, list[_Node]]:
    """The root, and all nodes in page order."""
    root = _Node("#", None, 0)
    here, nodes, at, lower = root, [root], 0, None
    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            here.children.append(page[at:])
            break
        if m.start() > at:
            here.children.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            up = here
            while up is not root and up.tag != tag:
                if tag not in BLOCK and up.tag in BLOCK:
                    up = root  # an inline end tag doesn't end a block
                    break
                up = up.parent
            if up is not root:
                here = up.parent
            continue
        if tag in BLOCK and here is not root:
            up = here
            while up is not root and (up.tag == "p" or up.tag not in BLOCK and up.tag not in ("td", "th", "button")):
                if up.tag == "p":
                    here = up.parent
                    break
                up = up.parent
        if tag in _ENDS:
            up = here
            while up is not root and up.tag not in _SCOPE[tag]:
                if up.tag in _ENDS[tag]:
                    here = up.parent
                up = up.parent
        node = _Node(tag, here, _is_noise(tag, m[3], here))
        here.children.append(node)
        nodes.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            lower = lower if lower is not None else page.lower()
            end = lower.find(f"</{tag}", at)
            at = n if end < 0 else end
            if end >= 0:
                close = page.find(">", end)
                at = n if close < 0 else close + 1
            continue
        here = node
    return root, nodes


def _measure(nodes: list[_Node]) -> None:
    for node in reversed(nodes):  # children come after their parents
        if node.noise:
            continue
        for x in node.children:
            if isinstance(x, str):
                node.chars += len(x.strip())
            elif not x.noise:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.chars if x.tag == "a" else x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
                node.whole = node.whole and x.whole
    body = next((x for x in nodes if x.tag == "body"), nodes[0])
    share = body.link_chars / max(1, body.chars)
    for node in reversed(nodes):
        if node.noise or not node.chars:
            continue
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, node.link_tags
        inner = c / max(1, lc) * t / max(1, lt)
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        node.density = c / t * (math.log(max(inner, 1.0)) / math.log(base) if base > 1.0001 else math.log(max(inner, 1.0)))
        # a leaf block has no block in it; its own density counts
        inside = [x for x in node.children if not isinstance(x, str)]
        node.sum = node.density if all(x.whole for x in inside) else sum(x.density for x in inside)


def _largest(node: _Node) -> _Node:
    best, stack = node, [node]
    while stack:
        x = stack.pop()
        if x.sum > best.sum:
            best = x
        stack += [y for y in reversed(x.children) if not isinstance(y, str) and not y.noise and not y.whole]
    return best


def _mark(nodes: list[_Node]) -> None:
    body = next((x for x in nodes if x.tag == "body"), nodes[0])
    core = _largest(body)
    threshold, up = core.density, core
    while up is not None and up is not body.parent:
        threshold, up = min(threshold, up.density), up.parent
    core.mark = True
    stack = [x for x in body.children if not isinstance(x, str)]
    while stack:
        node = stack.pop()
        if node.noise or node.mark or node.density < threshold or not node.chars:
            continue
        _largest(node).mark = True
        if node.mark:
            continue
        stack += [x for x in node.children if not isinstance(x, str)]


def extract_text(page: str | None) -> str:
    """The main text: blocks in page order, joined by newlines; white space inside a block is one space. Empty if there is none."""
    if not page:
        return ""
    root, nodes = _tree(page)
    _settle(nodes)
    _measure(nodes)
    _mark(nodes)
    blocks: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(now).split()):
            blocks.append(text)
        now.clear()

    stack: list[tuple[_Node | str | None, bool]] = [(root, False)]
    while stack:
        x, on = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            if on:
                now.append(html.unescape(x) if "&" in x else x)
        elif not x.noise:
            begins, on = x.mark and not on, on or x.mark
            if x.tag in BLOCK or begins:
                flush()
                stack.append((None, on))
            elif on and x.tag in SPACED:
                now.append(" ")
                if x.children:
                    stack.append((" ", on))
            stack += [(y, on) for y in reversed(x.children)]
    flush()
    return "\n".join(blocks)


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """id, the kept columns, text, n_chars (code points) of every page, from its whole html; null or empty html has empty text.

    Each row has a row, repeated ones too; other columns are left out. Broken markup is read as far as it goes. Of subtrees with
    equal sums the first in page order is the core. A very long page is read whole, in one worker: its tree takes some hundred
    bytes for each element. An empty table gives no rows.
    """
    small_batches(df.sparkSession)
    names = [id_col, *keep]
    kinds = dict(df.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract_text(batch.column(len(names))[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    columns = [F.col(f"`{x}`") for x in (*names, html_col)]
    return df.select(*columns).mapInArrow(tidy(run), ", ".join(f"`{x}` {kinds[x]}" for x in names) + ", text string, n_chars long")
