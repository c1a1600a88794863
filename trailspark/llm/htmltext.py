"""Main text of web pages by composite text density.

Every node of a page's tree has a link-adjusted density of characters per tag; a node's density sum is the sum of its children's
densities. The subtree of the greatest sum is the article; the least density on the path from it to the body is the threshold by which
further subtrees outside it join.

Elements that never are article text by what they are (scripts, menus, footers and the like) leave the tree at once. Names only weigh
densities: a class token, id or role that names an element as something else, made of such names and of words for places alone,
weighs all below it by the share of the page's text it holds, a name for reader comments by a tenth of that. What stands around the
densest subtree is never dropped, whatever its names; other named elements are. An article or main element weighs at least what its
heaviest part does. With the article go the headline before it, what stands between two parts of it, and plain text beside it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from .common import mapped, picked

#: HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("head script style noscript template nav footer aside button select textarea iframe svg canvas object audio video dialog menu title".split())
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header address details summary hr fieldset center hgroup".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag closes an open element of these names, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
SCOPE = frozenset("body article main section div td th li blockquote table button figure details".split())
#: Words of a class token, id or role that say what isn't the article; words for reader comments; those that may be a paper's chapter.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promos promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead toolbar topbar cookie cookies "
    "consent gdpr notice notices notification notifications popup modal overlay newsletter signup login pagination pager pagenav skiplink".split()
)
TALK = frozenset("comment comments commentlist disqus replies reply respond remark remarks".split())
MAYBE_TALK = frozenset("discussion discussions response responses feedback conversation conversations reactions opinions".split())
#: Words that bar a subtree outside the article.
WEAK = frozenset("related recommended recommendations share sharing social subscribe search tags widget copyright legal disclaimer alert teaser teasers header contentinfo complementary".split())
#: Words for places and parts, which may stand beside such a word: left-sidebar, comment-list, ad-slot-2.
PLACES = frozenset(
    "left right top bottom upper lower main site page global primary secondary section area list box block wrap wrapper container content inner outer bar row col column item items slot unit panel module holder region zone group "
    "link links text title body form thread user users reader readers post entry article blog first second widget widgets header".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
#: Names of a paper's chapters; a page with two of them has chapters, not talk.
CHAPTERS = frozenset("abstract introduction background methods method materials results conclusion conclusions references".split())
#: Blocks that are plain text beside the article.
PLAIN = frozenset("p ul ol dl blockquote pre table figure h2 h3 h4 h5 h6".split())
#: Share of link text up to which a subtree may join; weight of comments.
LINKS, TALKING = 0.3, 0.1
#: How sure it is that a node isn't the article.
OPEN, BARRED_OUTSIDE, NAMED, COMMENTS, NEVER = range(5)


def named(name: str, attrs: dict) -> int:
    """What an element's attributes say. Headings, article and main elements are named as comments alone."""
    found = OPEN
    for token in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        words = {x.lower() for x in PART.findall(token)} or {""}
        rest = {x for x in words - PLACES if not x.isdigit()}
        if rest and rest <= TALK | MAYBE_TALK:
            return COMMENTS
        if rest and rest <= NAMES:
            found = max(found, NAMED)
        elif rest and rest <= NAMES | WEAK or words <= {"header"} or words <= {"widget", "widgets"}:
            found = max(found, BARRED_OUTSIDE)
    style = (attrs.get("style") or "").replace(" ", "").lower()
    if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or "display:none" in style or (attrs.get("role") or "").lower() in ROLES:
        found = NAMED
    return OPEN if name in ("article", "main") or name in HEADINGS else found


PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_a-zA-Z]+")


class Node:
    __slots__ = ("name", "parent", "parts", "kind", "drop", "chars", "link_chars", "tags", "links", "density", "weight", "total", "top")

    def __init__(self, name: str, parent: Node | None, kind: int = OPEN):
        self.name, self.parent, self.parts, self.kind, self.drop = name, parent, [], kind, kind == NEVER


class Tree(HTMLParser):
    """A page's tree; what never is article text is marked."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)
        self.open: Counter[str] = Counter()  # open elements by name
        self.maybe: list[Node] = []  # elements that are a paper's chapters or comments
        self.chapters: set[str] = set()

    def handle_starttag(self, name: str, attrs: list) -> None:
        if name in ("html", "body"):
            return
        if name == "br" or name == "hr":
            self.at.parts.append(None if name == "hr" else " ")
            return
        if name in VOID:
            return
        if name in BLOCK:
            self.leave({"p"}, SCOPE)
            if (name in HEADINGS and self.at.name in HEADINGS) or self.at.name == "head":
                self.close_element(self.at)
        if name in CLOSES:
            self.leave(*CLOSES[name])
        found = dict(attrs)
        kind = NEVER if name in SKIP or name == "header" and not (self.open["article"] or self.open["main"]) else max(NAMED if name == "form" else OPEN, named(name, found) if attrs else OPEN)
        node = Node(name, self.at, kind)
        self.at.parts.append(node)
        self.open[name] += 1
        self.at = node
        words = {x.lower() for x in f"{found.get('class') or ''} {found.get('id') or ''}".split()}
        self.chapters |= words & CHAPTERS
        if kind == COMMENTS and words & MAYBE_TALK:
            self.maybe.append(node)

    def handle_startendtag(self, name: str, attrs: list) -> None:
        self.handle_starttag(name, attrs)  # a slash is ignored, as browsers do

    def close_element(self, node: Node) -> None:
        """Closes a node and all that is open in it."""
        while self.at is not node.parent:
            self.open[self.at.name] -= 1
            self.at = self.at.parent

    def leave(self, names: set, stop: frozenset | set) -> None:
        """Closes the outermost open element of names that stands below the nearest of stop."""
        if not any(self.open[x] for x in names):
            return
        node, found = self.at, None
        while node.parent is not None and node.name not in stop - names:
            if node.name in names:
                found = node
            node = node.parent
        if found is not None:
            self.close_element(found)

    def handle_endtag(self, name: str) -> None:
        if name in ("html", "body"):
            return
        if name == "br":
            self.at.parts.append(" ")
            return
        node = self.at
        while node.parent is not None and self.open[name]:
            if node.name == name:
                self.close_element(node)
                return
            if name not in BLOCK and name not in SKIP and node.name in BLOCK:
                return  # an inline end tag doesn't close a block
            node = node.parent

    def handle_data(self, text: str) -> None:
        self.at.parts.append(text)
        if self.at.name in HEADINGS and (word := text.strip().lower()) in CHAPTERS:
            self.chapters.add(word)

    def close(self) -> None:
        super().close()
        if len(self.chapters) > 1:
            for node in self.maybe:
                node.kind = OPEN


def bottom_up(root: Node) -> list[Node]:
    """Kept nodes, children before parents, without recursion."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(x for x in node.parts if isinstance(x, Node) and not x.drop)
    return order[::-1]


def kids_of(node: Node) -> list[Node]:
    return [x for x in node.parts if isinstance(x, Node) and not x.drop]


def sized(root: Node) -> list[Node]:
    """Characters and tags of every kept node, of all and of links alone."""
    order = bottom_up(root)
    for node in order:
        kids = kids_of(node)
        node.chars = sum(len(" ".join(x.split())) for x in node.parts if isinstance(x, str)) + sum(x.chars for x in kids)
        node.tags = sum(1 + x.tags for x in kids)
        node.links = sum((x.name == "a") + x.links for x in kids)
        node.link_chars = node.chars if node.name == "a" else sum(x.link_chars for x in kids)
    return order


def density(node: Node, base: float) -> float:
    """Characters per tag; link text among much other text, and links among many tags, take little from it. base: the page's share of link text."""
    if not node.chars:
        return 0.0
    tags, link_chars, links, other = max(1, node.tags), max(1, node.link_chars), max(1, node.links), max(1, node.chars - node.link_chars)
    return node.chars / tags * max(0.0, math.log(max(1.0001, node.chars / link_chars * tags / links), math.log(node.chars / other * link_chars + base * node.chars + math.e)))


def measure(root: Node) -> list[Node]:
    """Kept nodes, children before parents, with density, weight, total and top (the greatest total below an article or main element)."""
    order = sized(root)
    base = root.link_chars / max(1, root.chars)
    for node in order[::-1]:
        share = node.chars / max(1, root.chars)
        own = 1.0 if node.kind == OPEN else TALKING * share if node.kind == COMMENTS else share
        node.weight = own if node.parent is None else min(node.parent.weight, own)
        node.density = density(node, base)
    for node in order:
        kids = kids_of(node)
        node.total = sum(x.weight * x.density for x in kids)
        node.top = max([x.top for x in kids if not (node.name == "main" and x.name == "article")] + [node.total])
        if node.name in ("article", "main") and node.kind == OPEN:
            node.total = node.top
            node.top = node.total if node.name == "article" and node.parent is not None and node.parent.name == "article" else 0.0  # what lies around weighs its own
    return order


def path_of(node: Node | None) -> list[Node]:
    """A node and all around it, from the inside out."""
    found = []
    while node is not None:
        found.append(node)
        node = node.parent
    return found


def heaviest(order: list[Node]) -> Node:
    """Of several of the greatest total the outermost."""
    return max((x for x in order[::-1] if x.name in BLOCK), key=lambda x: x.total)


def headline(root: Node, best: Node, on_path: set[int]) -> Node | None:
    """The last h1 before the article, if it has none itself. One in a page header counts where the header stands in what is around the article."""
    if any(x.name == "h1" for x in bottom_up(best)):
        return None
    found, todo = None, [root]
    while todo:
        node = todo.pop()
        if node is best:
            break
        if node.name == "h1" and node.weight == 1.0:
            found = node
        for x in reversed(node.parts):
            if isinstance(x, Node) and x.kind == NEVER and x.name == "header" and node is not root and id(node) in on_path:
                heading = next((y for y in x.parts if isinstance(y, Node) and y.name == "h1"), None)
                if heading is not None:
                    x.drop, x.weight, heading.weight = False, 1.0, 1.0
                    for y in x.parts:
                        if isinstance(y, Node) and y is not heading:
                            y.drop = True
                    todo.append(heading)
            elif isinstance(x, Node) and not x.drop:
                todo.append(x)
    return found


def chosen(root: Node) -> set[int]:
    """The ids of the nodes whose whole subtrees are the article. Named nodes that don't stand around the densest one are dropped."""
    order = measure(root)
    best = heaviest(order)
    densest = max((x for x in bottom_up(best) if x.name in BLOCK), key=lambda x: (x.total, x.density)) if best.total else root
    spared = {id(x) for x in path_of(densest)}
    for x in order:
        x.drop = x.drop or x.kind in (NAMED, COMMENTS) and id(x) not in spared
    if not best.total:
        return {id(root)}
    path = path_of(best)
    threshold, on_path = min(x.density for x in path), {id(x) for x in path}
    keep, todo = {id(best)}, [root] if best is not root else []
    fits = lambda x: x.name in BLOCK and x.kind == OPEN and x.link_chars <= LINKS * x.chars
    while todo:
        kids = kids_of(around := todo.pop())
        for x in kids:
            if id(x) in on_path:
                todo += [x] if x is not best else []
            elif fits(x) and x.density >= threshold:
                keep.add(id(x))
            elif x.kind == OPEN:
                todo.append(x)
        if id(around) in on_path:
            parts = [i for i, x in enumerate(kids) if id(x) in keep or id(x) in on_path]
            keep |= {id(x) for x in kids[parts[0] : parts[-1]] if id(x) not in on_path and fits(x)}  # between parts of the article
            if around is not root:
                for beside in (kids[parts[-1] + 1 :], kids[: parts[0]][::-1]):
                    for x in beside:
                        if not (x.name in PLAIN and fits(x)):
                            break
                        keep.add(id(x))
    if (title := headline(root, best, on_path)) is not None:
        keep.add(id(title))
    return keep


def blocks(root: Node) -> list[str]:
    keep, out, line = chosen(root), [], []

    def flush() -> None:
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    todo: list[tuple] = [(root, False)]
    while todo:
        part, on = todo.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            if on:
                line.append(part)
        elif not part.drop:
            on = on or id(part) in keep
            block = part.name in BLOCK
            if block:
                flush()
                todo.append((None, on))
            todo.extend((x, on) for x in reversed(part.parts))
    flush()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    return "\n\n".join(blocks(tree.root))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page. A null or empty page, or one without article text, has an empty text;
    repeated rows and null ids stay, an empty table gives an empty one, other columns of pages don't matter. Pages of any length and
    depth take linear time: nothing recurses. Lone surrogates don't occur in Arrow strings."""

    def run(rows) -> dict:
        texts = [main_text(x).encode("utf-8", "replace").decode() for x in rows["html"].to_pylist()]
        return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(x) for x in texts]}

    kind = lambda c: pages.schema[c].dataType.simpleString()
    return mapped(picked(pages, page_id=id_col, url=url_col, html=html_col), run, f"page_id {kind(id_col)}, url {kind(url_col)}, text string, n_chars long")
