"""Main text of a page by composite text density.

A page is parsed to a tree (tolerantly: unclosed and crossed tags, raw-text elements, truncated
markup). What is never shown as text (head, scripts, styles, templates, hidden elements, form controls)
is left out. For every node of the rest, the composite density is characters per tag, adjusted by the
share of linked text against the share in the body; a node's density sum adds up its children's
densities. The subtree with the largest sum is chosen, and the least density on the path from the body
down to it is the threshold: what stands beside that path is kept where its own density reaches it.

Elements that say of themselves that they are no article text are never chosen and are left out of what
is chosen, but count in the densities: menus, footers, sidebars, forms and page headers by tag or role,
and containers (not paragraphs, headings, lists' items or cells) by a class or id that names a notice,
an advert, reader comments and the like (cookie-notice, sidebar-left; not has-sidebar or comments-open).
A name never leaves out an element outside which no article or main lies and which holds one, or more
than half of the page's text. Two things are kept whole with the chosen subtree: the <article> that it
lies in, and headings right beside kept blocks below the body.

Text: character references are decoded, white space inside a block becomes one space, blocks are
joined in page order by one space. Nothing else is dropped or capped.

Defined cases: null or empty html, or a page without article text, gives ''; a page without links has
plain characters per tag as density (the adjustment has no reference there); equal sums go to the
first node in page order; repeated rows are extracted each; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

# Names from the HTML standard and words that mark what is not article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
UNSEEN = frozenset("head script style noscript template title button select option textarea input iframe svg canvas object noembed noframes xmp".split())
CUT_TAGS = frozenset("nav footer aside form menu dialog".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars footer comment comments reply replies disqus notice notices cookie cookies consent gdpr newsletter subscribe subscription popup modal overlay related share sharing social widget login signup masthead toolbar pagination pager".split()
)
#: A class cuts by its last piece, or by its first where only these and numbers follow; not after a piece that tells of a state.
CUT_NOUNS = frozenset("area articles bar block body bottom box button buttons center col column container content form frame group header heading holder icon icons inner item items label left link links list main message news outer panel placeholder posts right row section slot space stories text thread title top unit wrap wrapper zone".split())
STATES = frozenset("has have is no non not hide show with without".split())
NUMBER = re.compile(r"\d+(?:x\d+)?")
CUT_OUTSIDE = frozenset({"header"})
NEVER_CUT = frozenset({"html", "body", "article", "main"})
#: Text of these is the article's whatever their names.
NEVER_NAMED = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre code figure figcaption li dt dd td th tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split()),
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot", "thead"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
}
#: An end or start tag does not reach past these to close something outside.
SCOPE = frozenset("article aside body div footer form header html main nav section table td th ul ol dl blockquote".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("children", "chars", "density", "link_chars", "link_tags", "parent", "sum", "tag", "tags", "cut", "named", "unseen")

    def __init__(self, tag: str, parent: Node | None, cut: bool, named: bool = False, unseen: bool = False) -> None:
        self.tag, self.parent, self.cut, self.named, self.unseen, self.children = tag, parent, cut, named, unseen, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def _names_cut(value: str) -> bool:
    """Whether a class or id names what is not article text."""
    for token in value.split():
        pieces = [x for x in re.split(r"[_\-:]+", token) if x]
        if not pieces or not STATES.isdisjoint(pieces[:-1]):
            continue
        while len(pieces) > 1 and (pieces[-1] in CUT_NOUNS or NUMBER.fullmatch(pieces[-1])):
            pieces.pop()
        if pieces[-1] in CUT_WORDS:
            return True
    return False


def _cut(tag: str, attrs: str, stack: list[Node]) -> tuple[bool, bool, bool]:
    """Whether an element is no article text, whether only its name says so, and whether it is not shown at all."""
    if tag in NEVER_CUT:
        return False, False, False
    if tag in UNSEEN:
        return True, False, True
    cut = tag in CUT_TAGS or tag in CUT_OUTSIDE and not any(n.tag in ("article", "main") for n in stack)
    named = False
    if attrs and not attrs.isspace():
        for m in ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                named = named or tag not in NEVER_NAMED and _names_cut(value)
            if name == "role" and value.strip() in CUT_ROLES:
                cut = True
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return True, False, True
    return cut, named and not cut, False


def _cut_named(root: Node) -> None:
    """Mark the elements named as no article text, but for those that the article must lie in."""
    order = _post_order(root)
    if not any(n.named for n in order):
        return
    chars, articles = {}, {}
    for n in order:
        inner = [c for c in n.children if c.__class__ is Node]
        inner = [c for c in inner if not c.cut]
        chars[id(n)] = sum(chars[id(c)] for c in inner) + sum(len("".join(c.split())) for c in n.children if c.__class__ is str)
        articles[id(n)] = sum(articles[id(c)] for c in inner) + (n.tag in ("article", "main"))
    all_chars, all_articles = chars[id(root)], articles[id(root)]
    for n in order:
        if n.named and not (articles[id(n)] == all_articles and (all_articles or 2 * chars[id(n)] > all_chars)):
            n.cut = True


def parse(page: str) -> Node:
    """The tree under a root node; text is kept as strings among the children. What is not shown is not kept; what is no article text is marked."""
    root = Node("#root", None, False)
    stack = [root]
    at, size = 0, len(page)

    def text(s: str) -> None:
        top = stack[-1]
        if s and not top.unseen:
            top.children.append(html.unescape(s) if "&" in s else s)

    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            tail = page[at:]
            text(tail)
            break
        text(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i].tag not in INLINE or tag not in SCOPE and stack[i].tag in SCOPE:
                    break
            continue
        while True:  # implied end tags
            for i in range(len(stack) - 1, 0, -1):
                open_tag = stack[i].tag
                if tag in CLOSED_BY.get(open_tag, ()):
                    del stack[i:]
                    break
                if open_tag in SCOPE:
                    i = 0
                    break
            else:
                i = 0
            if not i:
                break
        top = stack[-1]
        node = Node(tag, top, *((True, False, True) if top.unseen else _cut(tag, m[3], stack)))
        if not node.unseen:
            top.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:/?>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
        elif tag not in VOID and tag not in ("svg", "math", "path"):
            stack.append(node)  # a slash does not close an HTML element
    _cut_named(root)
    return root


def _post_order(root: Node) -> list[Node]:
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [c for c in n.children if c.__class__ is Node]
    return order[::-1]


def measure(root: Node) -> Node:
    """Fill in counts, densities and density sums; returns the body."""
    order = _post_order(root)
    for n in order:
        for c in n.children:
            if c.__class__ is Node:
                n.chars += c.chars
                n.tags += c.tags + 1
                n.link_chars += c.chars if c.tag == "a" else c.link_chars
                n.link_tags += c.link_tags + (c.tag == "a")
            else:
                n.chars += len("".join(c.split()))
    body = next((n for n in reversed(order) if n.tag == "body"), root)
    share = body.link_chars / max(1, body.chars)
    for n in order:
        plain = n.chars / max(1, n.tags)
        if not body.link_chars or not n.chars:
            n.density = plain
            continue
        linked, links = max(1, n.link_chars), max(1, n.link_tags)
        base = math.log(n.chars / max(1, n.chars - n.link_chars) * n.link_chars + share * n.chars + math.e)
        n.density = max(0.0, plain * math.log(max(1.0, n.chars / linked * max(1, n.tags) / links)) / math.log(max(base, 1 + 1e-9))) if base > 1 + 1e-9 else plain
    for n in order:
        n.sum = sum(c.density for c in n.children if c.__class__ is Node and not c.cut)
    return body


def _best(top: Node) -> Node:
    best, todo = top, [top]
    while todo:
        n = todo.pop()
        if n.sum > best.sum:
            best = n
        todo += [c for c in reversed(n.children) if c.__class__ is Node and not c.cut]
    return best


def choose(body: Node) -> list[Node | str]:
    """What to keep, in page order: subtrees and bare text."""
    best = _best(body)
    threshold, n, whole = body.density, best, best
    while n is not None and n is not body:
        threshold = min(threshold, n.density)
        if n.tag == "article":
            whole = n
        n = n.parent
    path, n = set(), whole
    while n is not None:
        path.add(id(n))
        n = n.parent

    def beside(parent: Node) -> list:
        """Children of a node on the path: what is kept of them, and the one that the path goes through."""
        kept = []
        for c in parent.children:
            if c.__class__ is str:
                kept.append(c if len("".join(c.split())) >= max(1.0, threshold) else None)
            else:
                kept.append(c if id(c) in path or not c.cut and c.chars and c.density >= threshold else None)
        if parent is not body:
            for i, c in enumerate(parent.children):  # headings right beside what is kept
                if c.__class__ is Node and c.tag in HEADINGS and not c.cut:
                    after = next((k for k, x in zip(kept[i + 1 :], parent.children[i + 1 :], strict=True) if x.__class__ is Node or x.strip()), None)
                    kept[i] = c if after is not None else kept[i]
        return [c for c in kept if c is not None]

    out: list[Node | str] = []
    behind: list[list] = []
    node: Node | None = body
    while node is not None and node is not whole:  # down the path
        inner, after = None, []
        for c in beside(node):
            if c.__class__ is Node and id(c) in path:
                inner = c
            else:
                (out if inner is None else after).append(c)
        behind.append(after)
        node = inner
    out.append(whole)
    for after in reversed(behind):
        out += after
    return out


def blocks(nodes: list[Node | str]) -> Iterator[str]:
    held: list[str] = []

    def flush() -> Iterator[str]:
        if held:
            if s := " ".join("".join(held).split()):
                yield s
            held.clear()

    for top in nodes:
        yield from flush()
        todo: list = [top]
        while todo:
            n = todo.pop()
            if n is None:
                yield from flush()
            elif n.__class__ is str:
                held.append(n)
            elif n.cut:
                continue
            elif n.tag == "br":
                held.append("\n")
            elif n.tag in INLINE:
                todo += reversed(n.children)
            else:
                yield from flush()
                todo.append(None)
                todo += reversed(n.children)
    yield from flush()


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return " ".join(blocks(choose(measure(parse(page)))))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars) for rows with page_id, url, html."""
    small_batches(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), b.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
