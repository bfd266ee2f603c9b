"""Main text of web pages by tree scoring.

The page becomes a tree; scripts, styles, forms, menus, page headers, footers and sidebars leave it by their element or
role, notices, adverts and reader comments by the words of their class and id. A name that says so beyond doubt is enough
(``STRONG``); one that may also name a part of an article (``WEAK``, or with other words beside it) is not: such an
element goes only if it is short, dense with links or has several, and its text gives no points. Each other paragraph
passes points for its length and commas to its ancestors: all to the nearest, half to the next, a shrinking part further
up to the root; a wrapper without other text of its own counts as one with what it holds. An element's score is its
points, plus what its name suggests, times the share of its text outside links. The best element is the container;
siblings that score well or are proper paragraphs are kept with it. Blocks are joined in page order. Each step is one
pass over the tree, so deep and long pages take time in proportion to their length.

White space within a block (also <br>) becomes one space; character references are decoded; nothing is capped.

Defined cases: null or empty html gives the empty text; a page without tags is one block; unclosed, misnested and
unknown elements are repaired as browsers do; a page whose best container has no text gives all text left in its body;
repeated rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes", "svg", "select", "object", "canvas", "audio", "video")
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HOLDERS = frozenset("article body center details div figure html main section table tbody td th tr".split())
DROPPED = frozenset("aside button dialog fieldset footer form head menu nav".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split())
NEVER_BY_NAME = frozenset("article body h1 h2 h3 h4 h5 h6 html main".split())
# Words of class and id. The first must be a whole word, the second may begin one.
NAMED = frozenset("ad ads adv dfp menu modal nav navi overlay pager pagination popup rss share sharing social sticky tags toc toolbar topbar widget widgets".split())
BEGINNING = ("adsbygoogle", "adslot", "adsense", "advert", "breadcrumb", "comment", "consent", "cookie", "disclaimer", "disqus", "footer", "gdpr", "masthead", "navbar", "navigation", "newsletter", "notice", "notification", "outbrain", "paywall", "popup", "promo", "recommend", "related", "replies", "reply", "respond", "sidebar", "sharebar", "signup", "skiplink", "socialmedia", "sponsor", "subscri", "taboola", "trackback")
# Those of them that may as well name a part of an article, and words beside them that say nothing.
WEAK = ("disclaimer", "notice", "notification", "promo", "recommend", "related", "respond", "reply", "share", "sharing", "social", "sticky", "tags", "toc", "widget")
PLAIN = frozenset("a app area article articles bar banner block body bottom box button buttons card cell center col column container content div el element entry for footer form group header holder id image img inline inner item items js large layout left line link links list main message mobile module more of on outer page panel post posts reader region right row section side single site slot small space stories story text the thread title top unit user view wrap wrapper".split())
#: A named element of more text than this, with one link at most, reads as a part of the article.
PROSE, LONG_LINK = 60, 15
OUTSIDE_ARTICLE = ("banner", "header", "topnav")
GOOD = re.compile(r"article|body|content|entry|hentry|main|page|post|story|text", re.I)

_TOKEN = re.compile(r"""<!--.*?(?:-->|--!>|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
#: Open elements that a start tag ends, up to the nearest of the second.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Node:
    __slots__ = ("tag", "parent", "inside", "points", "up", "length", "linked", "links", "name", "in_article", "doubtful", "chosen", "left_out")

    def __init__(self, tag, parent, name="", in_article=False, doubtful=False):
        self.tag, self.parent, self.name, self.in_article, self.doubtful = tag, parent, name, in_article, doubtful
        self.inside: list = []
        self.points = self.up = 0.0
        self.length = self.linked = self.links = 0
        self.chosen = self.left_out = False


def _named(name: str, in_article: bool) -> str:
    """What the words of class and id say: STRONG, WEAK, or nothing."""
    found = ""
    for word in name.split():
        parts = [w.lower() for w in _WORDS.findall(word)]
        whole = "".join(parts)
        bad = [p for p in parts if p in NAMED or p.startswith(BEGINNING)] or ([whole] if whole.startswith(BEGINNING) else [])
        if bad:
            other = [p for p in parts if p not in bad and p not in PLAIN and not p.isdigit() and len(p) > 1] if bad != [whole] else []
            if not other and not all(p.startswith(WEAK) for p in bad):
                return "STRONG"
            found = "WEAK"
        elif not in_article and any(p in OUTSIDE_ARTICLE for p in parts):
            return "STRONG"
    return found


def _unwanted(tag: str, attributes: str, in_article: bool) -> tuple[bool, str, bool]:
    """Whether the element goes with all it holds, its class and id, and whether its name leaves that open."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return True, "", False
    if not attributes or attributes.isspace():
        return False, "", False
    a = {}
    for m in _ATTRIBUTE.finditer(attributes):
        a.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    name = f"{a.get('class', '')} {a.get('id', '')}"
    if tag in ("html", "body"):
        return False, name, False
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(a.get("style", "")):
        return True, name, False
    if tag in NEVER_BY_NAME:
        return False, name, False
    if a.get("role", "").lower() in ROLES:
        return True, name, False
    said = _named(name, in_article)
    return said == "STRONG", name, said == "WEAK"


class _Open:
    """The stack of open elements, with how many there are of each tag."""

    def __init__(self, root):
        self.stack, self.count = [root], Counter()

    def push(self, node) -> None:
        self.stack.append(node)
        self.count[node.tag] += 1

    def cut(self, at: int) -> None:
        self.count.subtract(n.tag for n in self.stack[at:])
        del self.stack[at:]

    def close(self, tag: str) -> None:
        """Ends the nearest element of the tag, which is open."""
        at = len(self.stack) - 1
        while self.stack[at].tag != tag:
            at -= 1
        self.cut(at)

    def end(self, tags: set[str], within: set[str]) -> None:
        """Ends the nearest open element of tags, unless one of within is nearer."""
        if any(self.count[t] for t in tags):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag in tags:
                    return self.cut(i)
                if self.stack[i].tag in within:
                    return None


def parse(page: str) -> tuple[Node, list[Node]]:
    """The tree of what is left of the page, and its nodes in page order: inside a node are nodes and strings, references
    still encoded."""
    root = Node("body", None)
    at, here, place, nodes = root, _Open(root), 0, [root]
    skipped, skips = [], Counter()  # open elements below a dropped one, it first
    end = len(page)
    while place < end:
        m = _TOKEN.search(page, place)
        if m is None or m.start() > place:
            text = page[place : m.start() if m else end]
            if not skipped:
                at.inside.append(text)
            if m is None:
                break
        place = m.end()
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if not close and tag in _END:
            if not attributes.endswith("/") or tag != "svg":
                stop = _END[tag].search(page, place)
                place = end if stop is None else (page.find(">", stop.end()) + 1 or end)
            continue
        if skipped:
            if close:
                if skips[tag]:
                    while (gone := skipped.pop()) != tag:
                        skips[gone] -= 1
                    skips[tag] -= 1
                elif tag in ("body", "html") or (tag in BLOCK and tag not in ("p", "br") and here.count[tag]):
                    skipped.clear()  # the end of an element around the dropped one ends it too
                    skips.clear()
                    if here.count[tag]:
                        here.close(tag)
                    at = here.stack[-1]
            elif skipped[0] == "head" and (tag == "body" or tag in BLOCK):
                skipped.clear()
                skips.clear()
            elif tag not in VOID:
                if tag in ("li", "dt", "dd", "p", "tr", "td", "th", "option") and skipped[-1] == tag:
                    skips[skipped.pop()] -= 1
                if skipped:
                    skipped.append(tag)
                    skips[tag] += 1
                    continue
            if skipped or close:
                continue
        if close:
            if tag not in ("body", "html") and here.count[tag]:
                here.close(tag)
                at = here.stack[-1]
            continue
        if tag in ("body", "html"):
            continue
        if tag in VOID:
            at.inside.append(" " if tag == "br" else Node(tag, at) if tag == "hr" else "")
            continue
        if tag in BLOCK:
            here.end({"p"}, {"td", "th", "table", "article", "section", "main", "div", "li", "blockquote"})
        if tag in _CLOSES:
            here.end(*_CLOSES[tag])
        at = here.stack[-1]
        gone, name, doubtful = _unwanted(tag, attributes, at.in_article)
        if gone:
            if tag in BLOCK or tag == "head":
                at.inside.append(Node("hr", at))  # still ends a block
            skipped.append(tag)
            skips[tag] += 1
            continue
        at = Node(tag, at, name, at.in_article or tag in ("article", "main"), doubtful)
        at.parent.inside.append(at)
        here.push(at)
        nodes.append(at)
    return root, nodes


def blocks(root: Node) -> list[tuple[Node, str, int]]:
    """(element, text, length of its linked text) of each block below root, in page order."""
    out, run, linked = [], [], [0]
    todo: list = [(root, root, False, iter(root.inside))]

    def flush(owner):
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                out.append((owner, text, min(linked[0], len(text))))
            run.clear()
            linked[0] = 0

    while todo:
        node, owner, link, inside = todo[-1]
        x = next(inside, None)
        if x is None:
            todo.pop()
            if node.tag in BLOCK:
                flush(node)
            continue
        if isinstance(x, str):
            run.append(x)
            if link:
                linked[0] += len(" ".join(html.unescape(x).split()))
        else:
            if x.tag in BLOCK:
                flush(owner)
            todo.append((x, x if x.tag in BLOCK else owner, link or x.tag == "a", iter(x.inside)))
    return out


def _measure(nodes: list[Node], found: list[tuple[Node, str, int]]) -> None:
    """Lengths, linked lengths and links of all nodes, from below."""
    for node in nodes:
        node.length = node.linked = node.links = 0
    for owner, text, linked in found:
        owner.length += len(text)
        owner.linked += linked
    for node in reversed(nodes):
        node.links += node.tag == "a"
        if node.parent is not None:
            node.parent.length += node.length
            node.parent.linked += node.linked
            node.parent.links += node.links


def _leave_out(nodes: list[Node]) -> bool:
    """Marks doubtful elements that don't read as prose, with all below them; whether there are any."""
    for node in nodes:
        above = node.parent is not None and node.parent.left_out
        prose = node.length >= PROSE and node.links <= 1 and node.linked < node.length / 3
        node.left_out = above or (node.doubtful and not prose)
        node.doubtful = node.doubtful or (node.parent is not None and node.parent.doubtful)  # gives no points below, either
    return any(node.left_out for node in nodes)


def _score_all(nodes: list[Node], found: list[tuple[Node, str, int]]) -> None:
    """Points of all nodes, from below: up is what goes on to the parent."""
    for owner, text, _ in found:
        if not owner.doubtful:
            first = (owner if owner.tag in HOLDERS else owner.parent) or owner
            first.points += (1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)) if len(text) >= 25 else len(text) / 1000
    for node in nodes:
        node.up = 0.5 * node.points
    for node in reversed(nodes):
        above = node.parent
        if above is not None:
            if above.length > node.length:
                above.points += node.up
                above.up += 0.6 * node.up
            elif node.length:  # a wrapper: it has what it holds
                above.points += node.points
                above.up += node.up


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    root, nodes = parse(page)
    found = blocks(root)
    _measure(nodes, found)
    if _leave_out(nodes):
        found = [b for b in found if not b[0].left_out]
        _measure(nodes, found)
    if not found:
        return ""
    _score_all(nodes, found)
    with_points = [n for n in nodes if n.points > 0]
    best = max(with_points, key=_score, default=root)
    most = _score(best) if with_points else -1.0
    while best.parent is not None and best.parent.length == best.length:  # siblings are those of its outermost wrapper
        best = best.parent
    best.chosen = True
    if best.parent is not None:
        for sibling in best.parent.inside:
            if isinstance(sibling, Node) and sibling is not best and sibling.length and not sibling.doubtful:
                density = sibling.linked / sibling.length
                kin = sibling.tag == best.tag and (sibling.name == best.name if best.name.strip() else best.tag == "section")
                good = sibling.points > 0 and _score(sibling) + 0.2 * most * kin >= 0.2 * most and density < 0.5
                if good or (sibling.tag == "p" and density < 0.25 and sibling.length > 80) or (sibling.tag in ("h1", "h2") and density < 0.25):
                    sibling.chosen = True
    menus = set()
    for node in nodes:  # parents come first
        above = node.parent
        node.chosen = node.chosen or (above is not None and above.chosen)
        if node is not best and above is not None and (id(above) in menus or (node.chosen and _menu(node))):
            menus.add(id(node))
    kept = [text for owner, text, _ in found if owner.chosen and id(owner) not in menus]
    return " ".join(kept or [text for _, text, _ in found])


def _score(node: Node) -> float:
    bonus = 25.0 if node.tag in ("article", "main") else 5.0 if node.tag in ("div", "section") and GOOD.search(node.name) else 0.0
    return (node.points + bonus) * (1 - node.linked / max(node.length, 1))


def _menu(node: Node) -> bool:
    """Whether a list or box is nothing but short links; longer ones are references."""
    return node.tag in ("ul", "ol", "div", "section") and node.linked >= 0.9 * node.length and len(node.inside) > 2 and node.linked < LONG_LINK * max(node.links, 1)


def main_texts(pages: DataFrame) -> DataFrame:
    """For each page page_id, url, text and its number of code points."""
    small_batches(pages.sparkSession)

    def run(batches):
        for b in batches:
            texts = [extract(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
