"""HTML extraction by composite text density.

Every node of a page's tree gets its characters per tag, adjusted for links: text in links
counts against a node the more, the less other text surrounds it, measured against the
ratio of link text in the whole body. The density sum of a node is the sum over its
children. The path from the body to the densest node sets the threshold, the least density
on it; the subtree with the largest density sum above the threshold chooses the root of the
main text: the main element that holds it, else the article that holds it and the articles
beside it, else, with the blocks around it, what the page has of headings, prose and parts
above the threshold. Inside the root nothing goes but boxes of links: blocks of LINKS links
or more whose text is links for the most part, without a line of prose, and, unless they are
sections, with no more than a heading besides.

What is never article text is parsed like the rest and then taken out of the tree: scripts,
styles, forms, menus, footers, sidebars, and blocks of which a whole class or role names an
advert, a notice, a menu or reader comments, if they do not hold the article. An id names
such a block outside of articles only; headings, inline elements and code are never taken
for one. Blocks inside the main text come in page order, joined by one space.

A page is one row and is parsed in one pass, with the tree of that page alone in memory.
Unclosed and crossing tags follow the usual rules: a new paragraph or list item closes the
open one, a closing tag closes what is open inside it, a stray one is ignored, and a page
that ends early is closed there. Null html is empty; a page without a body text gives an
empty text.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe xmp noembed noframes".split())
SKIPPED = RAW | set("""head nav footer aside form button select option menu dialog canvas audio video
datalist label fieldset noscript template svg math object""".split())
BLOCKS = set("""address article blockquote body caption center dd details div dl dt figcaption figure
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main ol p pre section summary table tbody td tfoot th
thead tr ul""".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# A start tag of the key closes an open element of the values.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("""ul ol dl table body html article section div main blockquote td th nav footer aside form
button select menu header fieldset dialog template object""".split())
# Their start tags close an open paragraph, which does not reach out of the others.
CLOSE_PARAGRAPH = BLOCKS | set("nav footer aside form menu dialog fieldset".split())
PARAGRAPH_SCOPES = set("button select noscript template svg math object".split())
UNWANTED_ROLES = set("""navigation banner contentinfo complementary search form dialog alertdialog
menu menubar toolbar alert""".split())
# Elements that a class may name as unwanted; PROSE characters outside of links are a line of prose.
NAMED = BLOCKS - HEADINGS - set("address caption dd dt figcaption html body article main hr pre summary tbody td tfoot th thead tr".split())
PROSE, LINKS = 60, 3
# Words of which a whole class or id consists if it names what the element is.
_UNWANTED = re.compile(r"""((^|[-_])(ads?|advert\w*|adsense|adbox|adslot|banner\w*|sponsor\w*|promo\w*|promotion\w*|
outbrain|taboola|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|side-?bar|aside|widget\w*|footer\w*|foot|
header|masthead|topbar|toolbar|cookies?|consent|gdpr|notice\w*|popup|modal|overlay|newsletter|subscribe|
subscription|signup|login|comments?|commentlist|comment-?\w*|disqus\w*|replies|reply|respond|discussion|
share|sharing|social\w*|related|recommend\w*|pagination|pager|paging|skip|copyright|legal|disclaimer|tags|
tag-?cloud|toc|search\w*|form)(?=$|[-_]))+$""", re.I | re.X)
_WRAPPER = re.compile(r"(wrap|wrapper|wrapping|container|layout|outer|inner)$", re.I)
_TOKEN = re.compile(r"""<!--.*?(?:-->|$) | <[!?][^>]*(?:>|$) |
<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*)(?:>|$)""", re.S | re.X)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "parent", "children", "unwanted", "ended", "chars", "tags", "link_chars", "link_tags",
                 "density", "total", "plain", "prose", "heading")

    def __init__(self, name: str, parent: Node | None, unwanted: str = "") -> None:
        self.name, self.parent, self.children = name, parent, []
        self.unwanted, self.ended = unwanted, False


def _named(value: str, inside_article: bool) -> bool:
    """Whether one of the classes or ids in `value` names an unwanted element itself."""
    return any(_UNWANTED.match(x) and not _WRAPPER.search(x) and not (inside_article and x.lower() == "header")
               for x in value.split())


def _unwanted(name: str, rest: str, inside_article: bool, inside_code: bool) -> str:
    """"element" or "name": what tells that it is unwanted; otherwise empty."""
    if name in SKIPPED or name == "header" and not inside_article:
        return "element"
    if not rest or name in ("html", "body", "article", "main") or inside_code:
        return ""
    found = ""
    for key, value in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'")
        if (key == "class" or key == "id" and not inside_article) and name in NAMED and _named(value, inside_article):
            found = "name"
        if key == "role" and value.lower() in UNWANTED_ROLES or key == "hidden":
            return "element"
        if key == "aria-hidden" and value.lower() == "true":
            return "element"
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "element"
    return found


def parse(page: str) -> Node:
    """The tree of a page without the unwanted elements."""
    root = Node("html", None)
    node, at, end = root, 0, len(page)
    names: list[str] = ["html"]
    still = Counter()  # how many elements of a name are open

    def up() -> None:
        nonlocal node
        still[names.pop()] -= 1
        node = node.parent

    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            node.children.append(entities.unescape(page[at:stop]))
        if not m:
            break
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if m["end"]:
            if still[name] > 0:
                while names[-1] != name:
                    up()
                node.ended = True
                up()
            continue
        rest = m["rest"] or ""
        if name in VOID:
            if name == "br":
                node.children.append(" ")
            elif name == "hr":
                node.children.append(Node("hr", node))
            continue
        if name in RAW:
            at = _raw_end(page, at, name) if not rest.endswith("/") else at
            continue
        while name == "body" and still["head"] > 0:
            up()
        unwanted = _unwanted(name, rest, still["article"] + still["main"] > 0, still["pre"] + still["code"] > 0)
        if unwanted and name == "body":
            continue
        if name in CLOSE_PARAGRAPH and still["p"] > 0:
            i = len(names) - 1
            while names[i] != "p" and names[i] not in PARAGRAPH_SCOPES:
                i -= 1
            if names[i] == "p":
                while len(names) > i:
                    up()
        if name in CLOSES and any(still[x] > 0 for x in CLOSES[name]):
            for i in range(len(names) - 1, 0, -1):
                if names[i] in CLOSES[name]:
                    while len(names) > i:
                        up()
                    break
                if names[i] in SCOPES and names[i] not in CLOSES[name]:
                    break
        if rest.endswith("/") and (unwanted or name not in BLOCKS):
            continue
        child = Node(name, node, unwanted)
        node.children.append(child)
        node = child
        names.append(name)
        still[name] += 1
    _prune(root)
    return root


_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|$)", re.I) for name in RAW}


def _raw_end(page: str, at: int, name: str) -> int:
    """The place after the end tag of an element whose content is no markup."""
    m = _ENDS[name].search(page, at)
    return m.end() if m else len(page)


def _prune(root: Node) -> None:
    """Takes the unwanted elements out of the tree.

    One that is unwanted by its class or id only, or without an end tag of its own, so that
    it may have run on over the page, stays if it holds an article more than half as long as
    the longest of the page, or most of the text of a page without articles. A main element
    without articles counts as one.
    """
    order = _postorder(root)
    if not any(n.unwanted for n in order):
        return
    chars: dict[Node, int] = {}
    longest: dict[Node, int] = {}
    for node in order:
        inner = _inner(node)
        own = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        chars[node] = own + sum(chars[c] for c in inner)
        longest[node] = max((longest[c] for c in inner), default=0)
        if node.name == "article" or node.name == "main" and not longest[node]:
            longest[node] = chars[node]
    weight = longest if longest[root] else chars
    for node in order:
        node.children = [c for c in node.children if isinstance(c, str) or not c.unwanted
                         or (not c.ended or c.unwanted == "name") and 2 * weight[c] > weight[root]]
        # What stands in an element without an end before its first article is its own.
        at = node
        while node.unwanted and not node.ended and longest[node] and at.name not in ("article", "main"):
            i = next((i for i, c in enumerate(at.children) if isinstance(c, Node) and longest[c]), None)
            if i is None:
                break
            del at.children[:i]
            at = at.children[0]
            if at.unwanted and not at.ended:
                break


def _inner(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node)]


def _postorder(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(_inner(node))
    return order[::-1]


def densities(root: Node) -> list[Node]:
    """All nodes, children first, with composite density and density sum set.

    Also whether a node holds a line of prose, `plain` being the text of its own outside of
    links and inner blocks, and whether it holds a heading.
    """
    order = _postorder(root)
    for node in order:
        inner = _inner(node)
        own = sum(len(_SPACE.sub(" ", c).strip()) for c in node.children if isinstance(c, str))
        node.chars = own + sum(c.chars for c in inner)
        node.tags = len(inner) + sum(c.tags for c in inner)
        link = node.name == "a"
        node.link_chars = node.chars if link else sum(c.link_chars for c in inner)
        node.link_tags = (1 if link else 0) + sum(c.link_tags for c in inner)
        node.plain = 0 if link else own + sum(c.plain for c in inner if c.name not in BLOCKS)
        node.prose = node.plain >= PROSE or any(c.prose for c in inner)
        node.heading = node.name in HEADINGS and node.chars > 0 or any(c.heading for c in inner)
    body = next((n for n in order if n.name == "body"), root)
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for node in order:
        chars, tags = node.chars, max(node.tags, 1)
        links, link_tags = max(node.link_chars, 1), max(node.link_tags, 1)
        if not chars:
            node.density = 0.0
        else:
            plain = max(chars - node.link_chars, 1)
            base = math.log(chars / plain * links + ratio * chars + math.e)
            node.density = chars / tags * (math.log(chars / links * tags / link_tags + 1) / base)
        node.total = sum(c.density for c in _inner(node))
    return order


def _floor(order: list[Node], body: Node) -> float:
    """The least density on the path from the densest node of `order` up to the body."""
    node = max((n for n in order if n.chars), key=lambda n: n.density, default=body)
    floor = body.density
    while node is not None and node is not body:
        floor, node = min(floor, node.density), node.parent
    return floor


def _container(node: Node, top: Node) -> Node:
    """Paragraphs beside the chosen one belong to it: the block around them, within `top`."""
    while node is not top and (node.name not in BLOCKS or node.name in HEADINGS or node.name == "p"):
        node = node.parent
    return node


def _is_links(node: Node) -> bool:
    """Whether a part is a box of links: a menu, a list of other pages."""
    return (node.name in BLOCKS and node.name not in HEADINGS and node.link_tags >= LINKS
            and 2 * node.link_chars > node.chars and not node.prose
            and not (node.name == "section" and node.heading))


def _without_links(top: Node) -> Node:
    """The root of a text without its boxes of links; a root of nothing else keeps them."""
    if _is_links(top):
        return top
    stack = [top]
    while stack:
        node = stack.pop()
        if node.name == "section" and node.heading and not node.prose:
            continue  # a list of sources, say
        node.children = [c for c in node.children if isinstance(c, str) or not _is_links(c)]
        stack.extend(_inner(node))
    return top


def _around(found: Node, body: Node, floor: float) -> list[Node | str]:
    """The chosen subtree and what stands around it, up to the body.

    From each part beside the way up to the body stay headings, parts with a line of prose,
    and parts above the threshold.
    """
    way = {found}
    node = found
    while node is not body and node.parent is not None:
        node = node.parent
        way.add(node)
    out: list[Node | str] = []
    stack: list[Node | str] = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str) or item is found:
            out.append(item)
        elif item in way:
            stack.extend(item.children[::-1])
        elif item.name not in BLOCKS:
            if item.chars:
                out.append(item)
        elif item.name in HEADINGS or item.chars and item.density >= floor:
            out.append(item)
        elif item.prose or item.heading and not _is_links(item):
            stack.extend(item.children[::-1])
    return out


def main_parts(root: Node) -> list[Node | str]:
    """The main text: its root is chosen by the largest density sum above the threshold."""
    order = densities(root)
    body = next((n for n in order if n.name == "body"), root)
    floor = _floor(order, body)
    found = max((n for n in order if n.chars and n.density >= floor), key=lambda n: n.total, default=body)
    scope, node = {}, found
    while node is not None:
        if node.name in ("article", "main"):
            scope[node.name] = node
        node = node.parent
    if "main" in scope:
        return [_without_links(scope["main"])]
    if "article" in scope:
        beside = [n for n in _inner(scope["article"].parent) if n.name == "article" and n.chars]
        return [_without_links(n) for n in beside]
    return [n if isinstance(n, str) else _without_links(n) for n in _around(_container(found, root), body, floor)]


def blocks(parts: list[Node | str]) -> list[str]:
    """The texts of the blocks of some subtrees, in page order; white space is one space."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(held)).strip()
        if text:
            out.append(text)
        held.clear()

    stack: list[tuple[object, bool]] = [(part, False) for part in reversed(parts)]
    while stack:
        item, done = stack.pop()
        if isinstance(item, str):
            held.append(item)
            continue
        block = item.name in BLOCKS
        if block:
            flush()
        if not done:
            stack.append((item, True))
            stack.extend((c, False) for c in reversed(item.children))
    flush()
    return out


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    return " ".join(blocks(main_parts(parse(page))))


def extract_pages(pages: DataFrame) -> DataFrame:
    """`pages` without html, and with text and n_chars; columns of these names are replaced."""
    pages = pages.drop("text", "n_chars")
    at = pages.columns.index("html")
    names = [c for c in pages.columns if c != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py()) for h in batch.column(at)]
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*names, "text", "n_chars"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.schema.fields if f.name != "html")
    return pages.mapInArrow(run, f"{fields}text string, n_chars long")
