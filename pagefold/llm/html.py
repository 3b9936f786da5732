"""Main-text extraction from HTML by tree scoring.

A page is scanned into a light tree. Furniture that its element, role or state proves (menus, forms, hidden parts and so on) is
cut out. Parts whose class or id names furniture are cut, too, unless they hold the article or nothing else would be left. Each
paragraph then earns points for its length and its commas and passes them on to its ancestors in falling shares; a container's
score is discounted by the share of its text that stands in links, and lowered if its class or id merely mentions furniture. The
best container is kept together with the siblings that score well or are plain prose, and widened to the article around it.
A page takes time in proportion to its length, however deep its elements are nested. Every page is a row of its own, so the plan is
one narrow pass without a shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is not text of the page.
RAW = frozenset("script style noscript template svg math iframe object canvas audio video textarea title xmp noembed noframes".split())
#: Elements that are never part of the main text.
FURNITURE = frozenset("nav footer aside form button select option optgroup input label dialog menu head datalist map".split()) | RAW
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th pre "
    "blockquote figure figcaption address fieldset legend details summary center form hr hgroup search dialog menu dir listing".split()
)
#: Elements whose start closes an open one of the second set, as the standard's implied end tags do.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th", "tbody"), "tfoot": ("tbody", "tr", "td", "th")}
#: Elements that an implied end tag doesn't look beyond.
FENCE = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tablist tooltip status".split())
#: Words of a class or id that mark furniture.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox banner banners billboard sponsor sponsored sponsors promo promos promoted promotion "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pager pagination paging sidebar sidebars aside rail masthead footer foot header topbar "
    "toolbar cookie cookies consent gdpr notice notices notification notifications popup modal overlay lightbox dialog newsletter subscribe subscription signup "
    "login register search share sharing social follow related recommended recommendations recirculation outbrain taboola trending widget widgets comment comments "
    "commentlist respond disqus replies reactions discussion feedback copyright disclaimer legal skip hidden tags tagcloud shoutbox".split()
)
#: Words beside them in a name that say where the furniture stands or what it is made of.
PLACES = frozenset("left right top bottom box block wrap wrapper container area section sections list inner outer bar primary secondary content panel item items group main site page region zone holder links 1 2 3".split())
#: Words before them that say that a part only knows of furniture.
MENTIONS = frozenset("has have with without no not is hide show open close closed enable enabled disable disabled before after under above below inline allow".split())
#: Headers of the article itself stand inside these.
ARTICLE = frozenset(("article", "main"))
PARAGRAPH = frozenset("p pre td blockquote li dd figcaption h1 h2 h3 h4 h5 h6".split())
#: What a container's score is multiplied with if its class or id mentions furniture.
LOWERED = 0.5

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<([!?])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
#: Attributes in turn, each with its value, so that nothing inside a quoted value counts as one.
ATTRIBUTE = re.compile(r"""([^\s"'=/>][^\s=/>]*)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s"'>][^\s>]*))?|"[^"]*"?|'[^']*'?""")
HINTS = frozenset("class id role hidden aria-hidden style".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z0-9]+")


class Node:
    __slots__ = ("commas", "cut", "kept", "links", "lowered", "owner", "parent", "points", "size", "suspect", "tag")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.cut, self.suspect, self.kept, self.lowered = tag, parent, False, False, False, False
        self.owner: Node = self if parent is None or tag in BLOCK else parent.owner  # the block that the text belongs to
        self.points, self.size, self.links, self.commas = 0.0, 0, 0, 0


def name_says(value: str) -> tuple[set[str], bool]:
    """Words of a class or id that name furniture as the thing itself, and whether a word mentions any."""
    named, mentions = set(), False
    for token in value.split():
        words = [w.lower() for w in HUMP.split(token) if w]
        if WORDS.isdisjoint(words):
            continue
        mentions = True
        while len(words) > 1 and words[-1] in PLACES:
            words.pop()
        if words[-1] in WORDS and MENTIONS.isdisjoint(words):
            named.add(words[-1])
    return named, mentions


def judge(node: Node, attributes: str, inside: bool) -> None:
    """Marks furniture: cut if that is proved, suspect if a name says so, lowered if one mentions it. inside: within an article, where a header holds the title."""
    if node.tag in FURNITURE or node.tag == "header" and not inside:
        node.cut = True
        return
    if not attributes or node.tag in ("html", "body"):
        return
    seen = set()
    for m in ATTRIBUTE.finditer(attributes):
        name = (m[1] or "").lower()
        if name not in HINTS or name in seen:
            continue
        seen.add(name)
        value = html.unescape((m[2] or "").strip("\"'"))
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES or name == "style" and HIDDEN.search(value):
            node.cut = True
        elif name in ("class", "id") and node.tag not in ARTICLE:
            named, mentions = name_says(value)
            node.suspect |= bool(named - ({"header"} if inside else set()))
            node.lowered |= mentions


class Tree:
    """Nodes in page order, and the pieces of text: node, number of the block, text, whether in a link."""

    def __init__(self, page: str):
        root = Node("#root", None)
        self.order, self.texts = [root], []
        stack, blocks = [root], [0]  # open elements; places of those that are blocks
        open_at: dict[str, list[int]] = {}  # places of the open elements of each name
        number = links = inside = at = 0

        def close_to(place: int) -> None:
            nonlocal number, links, inside
            while len(stack) > place:
                node = stack.pop()
                open_at[node.tag].pop()
                if node.tag in BLOCK:
                    blocks.pop()
                    number += 1
                inside -= node.tag in ARTICLE
                links -= node.tag == "a"

        last = lambda tags: max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)
        add = lambda text: text and self.texts.append((stack[-1], number, text, links > 0))
        while m := TAG.search(page, at):
            add(page[at : m.start()])
            at = m.end()
            tag = (m[3] or m[6] or "").lower()
            if not tag:
                continue
            if m[2] or m[5]:
                place = last((tag,))
                # a stray end tag of a phrase doesn't close a block
                if place and (tag in BLOCK or place > blocks[-1]):
                    close_to(place)
                elif tag in BLOCK:
                    number += 1
                continue
            attributes = m[4] if m[3] else m[7] or ""
            if tag in BLOCK:
                number += 1
                if stack[blocks[-1]].tag == "p":
                    close_to(blocks[-1])
            if tag in IMPLIED:
                fence = last(FENCE.get(tag, ()))
                while (place := last(IMPLIED[tag])) > fence:
                    close_to(place)
            if tag in VOID:
                if tag == "br":
                    add(" ")
                continue
            if tag in RAW:
                if not attributes.rstrip().endswith("/") or tag not in ("svg", "math"):
                    end = RAW_END[tag].search(page, at)
                    at = end.end() if end else len(page)
                continue
            node = Node(tag, stack[-1])
            judge(node, attributes, inside > 0)
            open_at.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            stack.append(node)
            self.order.append(node)
            inside += tag in ARTICLE
            links += tag == "a"
        add(page[at:])


RAW_END = {tag: re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I) for tag in RAW}


def main_lines(tree: Tree, suspects: bool) -> list[str]:
    """The blocks of the main text; suspects says whether parts that are named like furniture are cut."""
    order = tree.order
    holds = set()  # what the article stands in isn't furniture, whatever its name
    for n in reversed(order):
        if n.parent is not None and (n.tag in ARTICLE and not n.cut or id(n) in holds):
            holds.add(id(n.parent))
    gone = set()
    for n in order:
        n.kept, n.points, n.size, n.links, n.commas = False, 0.0, 0, 0, 0
        if n.cut or suspects and n.suspect and id(n) not in holds or id(n.parent) in gone:
            gone.add(id(n))
    texts = [t for t in tree.texts if id(t[0]) not in gone]
    # points: each paragraph's own, passed on in falling shares
    own: dict[int, list] = {}
    for node, _, text, in_link in texts:
        size = len(" ".join(text.split()))
        n = node.owner
        n.size += size
        n.links += size if in_link else 0
        x = own.setdefault(id(n), [n, 0, 0])
        x[1] += size
        x[2] += text.count(",")
    for n in reversed(order):
        if n.parent is not None:
            n.parent.size += n.size
            n.parent.links += n.links
    for n, size, commas in own.values():
        if not size:
            continue
        earned = 1 + commas + min(size / 100, 3)
        up, level = (n.parent if n.tag in PARAGRAPH else n), 0
        while up is not None and up.parent is not None and level < 6:
            up.points += earned / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1

    def score(n: Node) -> float:
        return (1.25 if n.tag in ARTICLE else 1.0) * (LOWERED if n.lowered else 1.0) * n.points * (1 - n.links / n.size) if n.size else 0.0

    candidates = [n for n in order if n.points and id(n) not in gone]
    if not candidates:
        order[0].kept = True
    else:
        best = max(candidates, key=score)
        wide = best
        while wide is not None and wide.tag not in ARTICLE:
            wide = wide.parent
        best = wide or best
        threshold = max(1.0, 0.2 * score(best))
        best.kept = True
        first = True  # siblings before the best
        for n in order:
            if n is best:
                first = False
            elif n.parent is best.parent and id(n) not in gone and n.size:
                dense = n.links / n.size
                prose = n.tag in ("p", "blockquote", "pre") and dense < 0.25 or n.tag in ("h1", "h2") and first and best.tag not in ARTICLE
                if n.tag in BLOCK and (score(n) >= threshold and dense < 0.5 or prose):
                    n.kept = True
    for n in order:
        n.kept = n.kept or n.parent is not None and n.parent.kept
    lines: list[str] = []
    piece: list[str] = []
    before = -1
    for node, number, text, _ in texts:
        if not node.kept:
            continue
        if number != before and piece:
            lines.append("".join(piece))
            piece = []
        before = number
        piece.append(text)
    lines.append("".join(piece))
    clean = (" ".join(html.unescape(x).split()) for x in lines)
    return [x for x in clean if x]


def extract(page: str) -> str:
    """The main text: one line for each block, in page order."""
    tree = Tree(page)
    return "\n".join(main_lines(tree, True) or main_lines(tree, False))


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds ``text`` (and replaces it if there is one) to every row of pages.

    Null and empty html give an empty text; a page of any length is read whole; repeated rows are extracted one by one; an
    empty table gives an empty frame; all other columns, null or not, pass unchanged.
    """

    @F.pandas_udf("string")
    def main_text(pieces: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in pieces:
            yield pd.Series([extract(v) if v else "" for v in values], dtype=object)

    return pages.withColumn("text", main_text(F.col(html_col)))


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    out = extract_main_text(pages)
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
