"""Main text of web pages by composite text density.

A page becomes a tree, without the kinds of elements that are never the article by their tag or role (menus, scripts,
controls, footers ...). Each element has a density: its characters per tag, adjusted by how many of them stand in links;
and a sum: the densities of its children. Names of classes and ids only weigh: an element that is called an advert, a
comment and so on, or is a form, counts LIGHT times in its own density, in those of its descendants, and in what its
ancestors hold.

The element with the largest sum is the content. The threshold is the least density on the path from the body to it. The
best element under every element whose density reaches the threshold is content too, and so are headings beside the
path. An element within the content that weighs less than what it stands in stays only if its density reaches the threshold.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from spanwise.llm import common

# Element names of HTML.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody tfoot thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
NOISE_TAGS = frozenset(
    "nav footer aside button select textarea input option script style noscript template iframe svg math canvas "
    "object embed head title menu dialog xmp noembed noframes audio video map datalist label".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored sponsors promo "
    "promoted promotion cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay "
    "sidebar sidebars side rail foot nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead topbar comment comments "
    "commentlist disqus reply replies respond discussion share sharing social related recommended recommendations "
    "newsletter subscribe signup login search widget widgets pagination pager toolbar skip copyright disclaimer paywall "
    "form header hidden".split()
)
#: Of these, a class or id may stand inside an article for its own heading.
HEADING_WORDS = frozenset(("header",))
#: Of these, what makes an article element one that is not the page's own.
ARTICLE_WORDS = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related recommended".split())
#: Of the tags, those that may be wrapped round a whole page: they only weigh less.
WRAPPERS = frozenset(("form", "fieldset"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())
#: What an element of such a kind or name weighs.
LIGHT = 0.05
#: Elements that, if never closed, end where an article begins.
FORGOTTEN = frozenset(("nav", "header", "aside", "form", "menu"))
#: Start tags that end an open element of the first kind.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES_WITHIN = frozenset("ul ol dl table body article section div main".split())
#: Elements of the tree that do not begin a block of their own: a row's cells follow each other.
CELLS = frozenset(("td", "th"))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "parts", "weight", "inherited", "chars", "link_chars", "tags", "link_tags", "density", "total", "best", "marked")

    def __init__(self, tag: str, parent: Node | None, weight: float = 1.0):
        self.tag, self.parent, self.weight = tag, parent, weight
        self.inherited = weight * parent.inherited if parent else weight
        self.children: list[Node] = []
        self.parts: list = []  # texts, nodes, and None where a block ends or begins
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.marked = False


def weight_of(tag: str, attributes: str, inside_article: bool) -> float:
    """0 for what is never main text by its tag, role or style, LIGHT for forms and by the words of a class or id, else 1."""
    if tag in WRAPPERS:
        return LIGHT
    if tag in NOISE_TAGS or (tag == "header" and not inside_article):
        return 0.0
    if not attributes or tag in ("body", "html", "main"):
        return 1.0
    words, weight = ARTICLE_WORDS if tag == "article" else NOISE_WORDS, 1.0
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            for word in WORD.findall(value):
                word = word.lower()
                if word in words and not (inside_article and word in HEADING_WORDS):
                    weight = LIGHT
        elif name == "role" and value.strip().lower() in NOISE_ROLES:
            return 0.0
        elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true"):
            return 0.0
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            return 0.0
    return weight


def parse(page: str) -> Node:
    """The page's tree without what is never main text. Inline elements only count as tags unless they weigh less than
    others; links also mark their text."""
    root = node = Node("html", None)
    in_link, articles, inline, at, end = False, 0, 0, 0, len(page)
    skipping, depth = "", 0  # the element that is being cut, and how many of its name are open
    inside: list[str] = []  # blocks open within it

    def text(raw: str) -> None:
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            node.parts.append(raw)
            n = len(raw) if not raw.isspace() else 0
            node.chars += n
            node.link_chars += n * in_link

    def leave(name: str, stop: frozenset = frozenset()) -> None:
        """Ends the innermost open element of this name, and those within, unless one in stop is met first."""
        nonlocal node, articles, in_link, inline
        found = node
        while found is not None and found.tag != name:
            if found.tag in stop:
                return
            found = found.parent
        if found is None or found.parent is None:
            return
        in_link = False
        while node is not found.parent:
            articles -= node.tag in ("article", "main")
            inline -= node.tag not in BLOCK and node.tag not in CELLS
            node = node.parent
        if name in BLOCK or name in CELLS:
            node.parts.append(" " if name in CELLS else None)

    def is_open(name: str) -> bool:
        found = node
        while found is not None and found.tag != name:
            found = found.parent
        return found is not None and found.parent is not None

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            if not skipping:
                text(page[at:])
            break
        if not skipping:
            text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if skipping in FORGOTTEN and tag in ("article", "main") and not closing and weight_of(tag, attributes, False) == 1:
            skipping = ""
        if skipping and tag in BLOCK and tag != skipping:
            if not closing:
                inside.append(tag)
            elif tag in inside:
                while inside.pop() != tag:
                    pass
            elif is_open(tag):  # the end of what the cut element stands in
                skipping = ""
        if skipping:
            if tag == skipping:
                depth += -1 if closing else not attributes.endswith("/")
                if not depth:
                    skipping = ""
            elif not closing and tag in RAW:
                at = raw_end(page, at, tag)
            continue
        if closing:
            if tag == "a":
                in_link = False
            elif tag in BLOCK:
                leave(tag)
            elif tag in CELLS:
                leave(tag, frozenset(("table",)))
            elif inline:
                leave(tag)
            continue
        if tag == "br":
            node.parts.append(" ")
            node.tags += 1
            continue
        if tag in ("html", "body"):
            continue
        weight = weight_of(tag, attributes, articles > 0)
        if not weight:
            if tag in BLOCK:
                if node.tag == "p":
                    leave("p")
                node.parts.append(None)
            if tag in RAW:
                at = raw_end(page, at, tag)
            elif tag not in VOID and not attributes.endswith("/"):
                if tag == "head":  # ends where content begins, even if it is never closed
                    continue
                skipping, depth, inside = tag, 1, []
            continue
        if tag in RAW:
            at = raw_end(page, at, tag)
            continue
        if tag not in BLOCK and tag not in CELLS:
            node.tags += 1
            if tag == "a":
                in_link = True
                node.link_tags += 1
            elif weight < 1 and tag not in VOID and not attributes.endswith("/"):
                child = Node(tag, node, weight)
                node.parts.append(child)
                node.children.append(child)
                node = child
                inline += 1
            continue
        if tag == "hr":
            node.parts.append(None)
            node.tags += 1
            continue
        if node.tag == "p":
            leave("p")
        for name in CLOSES.get(tag, ()):
            leave(name, CLOSES_WITHIN)
        if tag[0] == "h" and tag[1:].isdigit() and node.tag[0] == "h" and node.tag[1:].isdigit():
            leave(node.tag)
        child = Node(tag, node, weight)
        node.parts.append(" " if tag in CELLS else None)
        node.parts.append(child)
        node.children.append(child)
        node = child
        articles += tag in ("article", "main")
    return root


def raw_end(page: str, at: int, tag: str) -> int:
    """Where the text of a script or the like ends; at the end of the page if it is never closed."""
    m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
    return m.end() if m else len(page)


def ordered(root: Node) -> list[Node]:
    """All nodes, each before its children, without recursion: pages may nest as deep as they like."""
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack.extend(reversed(node.children))
    return nodes


def density(chars: float, link_chars: float, tags: float, link_tags: float, page_ratio: float) -> float:
    """Characters per tag, times a logarithm that falls with the share of link characters and link tags. page_ratio is the
    share of the whole page's characters that stand in links."""
    if not chars:
        return 0.0
    tags, link_tags = max(tags, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + page_ratio * chars + math.e)
    return chars / tags * math.log(max(chars / max(link_chars, 1) * tags / link_tags, 1.0)) / max(base, 1.0)


def score(root: Node) -> list[Node]:
    """Sets every node's density, the sum of its children's densities, and the best node in its subtree, itself included."""
    nodes = ordered(root)
    for node in reversed(nodes):
        for child in node.children:
            node.chars += child.weight * child.chars
            node.link_chars += child.weight * child.link_chars
            node.tags += child.weight * (child.tags + 1)
            node.link_tags += child.weight * child.link_tags
    ratio = root.link_chars / max(root.chars, 1)
    for node in nodes:
        node.density = node.inherited * density(node.chars, node.link_chars, node.tags, node.link_tags, ratio)
    for node in reversed(nodes):
        node.total = sum(c.density for c in node.children) if node.children else node.density
        node.best = max((*(c.best for c in node.children), node), key=lambda n: n.total)  # of equals the innermost, the first
    return nodes


def mark(root: Node) -> float:
    """Marks the content's elements and returns the threshold."""
    nodes = score(root)
    content = root.best
    threshold, path = content.density, content
    while path.parent is not None and path.parent is not root:
        path = path.parent
        threshold = min(threshold, path.density)
    threshold = min(threshold, root.density)
    content.marked = True
    for node in nodes[1:]:
        if node.density > 0 and node.density >= threshold:
            target = node.best
            if target.tag in BLOCK and target.density >= threshold:
                target.marked = True
    path = content
    while path.parent is not None:
        for beside in path.parent.children:
            if beside.tag in HEADINGS and beside.weight == 1 and 2 * beside.link_chars <= beside.chars:
                beside.marked = True
        path = path.parent
    return threshold


def main_text(page: str) -> str:
    """The article's blocks, two line ends between them; empty where there is none."""
    if not page:
        return ""
    root = parse(page)
    threshold = mark(root)
    blocks, current = [], []
    stack: list = [(root, 0, root.marked)]

    def flush() -> None:
        if current:
            if block := SPACE.sub(" ", "".join(current)).strip():
                blocks.append(block)
            current.clear()

    while stack:
        node, k, inside = stack.pop()
        while k < len(node.parts):
            part = node.parts[k]
            k += 1
            if part is None:
                flush()
            elif isinstance(part, str):
                if inside:
                    current.append(part)
            else:
                stack.append((node, k, inside))
                node, k, inside = part, 0, part.marked or (inside and (part.weight == 1 or part.density >= threshold))
        if node.tag in BLOCK:
            flush()
    return "\n\n".join(blocks)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page.

    Returns id_col, url_col, text (empty for null or empty html and for pages without an article) and n_chars, its
    code points. Repeated rows give repeated results, null ids and urls stay null, an empty table gives none; other
    columns of pages are left out. Pages of any length are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = [main_text(x.decode("utf-8", "replace")) for x in common.utf8(batch.column(2))]
            yield {id_col: batch.column(0), url_col: batch.column(1), "text": texts, "n_chars": [len(x) for x in texts]}

    schema = f"`{id_col}` {common.type_of(pages, id_col)}, `{url_col}` string, text string, n_chars long"
    return common.map_batches(pages, [id_col, url_col, html_col], run, schema)
