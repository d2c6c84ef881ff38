"""Main text of web pages by consensus host paths.

Each page is parsed and its containers are scored by the text of the blocks in
them that are not boilerplate nor mostly links.  The page votes for the
generalised tag-class path of the lowest container that holds all of them, with
that much weight; Spark adds the votes up for each host.  Pages are then
extracted again from all elements of their host's winning path and what stands
directly beside them, or from their own container where that path has no text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.llm._common import written
from fleetlake.session import ship_code

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without main text, wherever they stand.
DROPPED = frozenset("head title script style noscript template nav footer aside form button select textarea input iframe object svg canvas audio video dialog menu".split())
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body div main section td center".split())
#: A start tag of the key ends open elements of the value.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article aside body div footer form header html main nav ol section table td th ul dl blockquote".split())
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|side-?bar|menu\w*|nav|navbar|navigation|breadcrumbs?|cookies?|consent|gdpr|notices?|newsletter|subscri\w*|sign-?up|login|"
    r"share|sharing|social|related|recommend\w*|comments?|comment-?list|respond|replies|disqus|popups?|modal|overlay|toolbar|pagination|pager|footer|site-?header|page-?header|masthead|topbar|skip-?link|widgets?|outbrain|taboola)(?:$|[\s_-])", re.I)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary dialog alertdialog alert search menu menubar toolbar form".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Class names that tell of a page's layout, not of what the element is.
LAYOUT = re.compile(r"(?:^|[_-])(?:has|with|without|no)[_-]", re.I)
#: Shares of a page's text above which an element, or the article in it, is not boilerplate by its name alone.
SHARE, ARTICLE_SHARE = 0.9, 0.5
#: Elements that only a whole class name or id tells to be boilerplate, not a part of one.
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 hgroup p table caption thead tbody tfoot tr td th li dt dd blockquote pre figure figcaption span a b i em strong code mark q sub sup time cite".split())
#: Names that comments of readers may have, and parts of articles too; the second ones only with a byline.
REACTIONS = frozenset("responses reactions talkback".split())
DEBATES = frozenset("feedback reviews discussion".split())
#: Names within an element that tell who wrote it or when.
BYLINE = re.compile(r"(?:^|[\s_-])(?:author|user|username|nick|avatar|byline|posted|reply|date|time|timestamp|votes?|likes?)(?:$|[\s_-])", re.I)
#: Blocks that belong to the container that they stand beside.
BESIDE = frozenset("h1 h2 h3 h4 h5 h6 hgroup p ul ol dl table blockquote pre figure".split())


class Node:
    __slots__ = ("tag", "path", "parent", "children", "dropped", "named", "size", "linked", "main", "reactions", "byline")

    def __init__(self, tag: str, path: str, parent: Node | None, dropped: bool, named: bool = False) -> None:
        self.tag, self.path, self.parent, self.dropped, self.named = tag, path, parent, dropped, named
        self.children: list[Node | str] = []
        self.size = self.linked = self.main = 0
        self.reactions = self.byline = False


def _noise(tag: str, attrs: dict[str, str | None], inside: set[str]) -> bool:
    if tag in DROPPED or (tag == "header" and not inside & {"article", "main"}):
        return True
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or (attrs.get("role") or "").lower() in NOISE_ROLES or HIDDEN.search(attrs.get("style") or ""):
        return tag not in ("html", "body")
    return False


def _names(attrs: dict[str, str | None]) -> list[str]:
    return f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split()


def _named_noise(tag: str, attrs: dict[str, str | None]) -> bool:
    if tag in ("html", "body", "article", "main"):
        return False
    names = [n for n in _names(attrs) if not LAYOUT.search(n)]
    return any(map(NOISE.fullmatch, names)) if tag in TEXTUAL else bool(NOISE.search(" ".join(names)))


class Tree(HTMLParser):
    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", "html", None, False)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body"):
            return
        if tag in BLOCKS and tag not in ENDS:
            self._end({"p"})
        if tag in ENDS:
            self._end(ENDS[tag])
        if tag in VOID:
            if tag in ("br", "hr"):
                self.at.children.append(" ")
            return
        known = dict(attrs)
        inside, node = set(), self.at
        while node is not None:
            inside.add(node.tag)
            node = node.parent
        classes = sorted({re.sub(r"\d+", "", c) for c in (known.get("class") or "").lower().split()} - {""})
        name = ".".join([tag, *classes])
        node = Node(tag, f"{self.at.path}/{name}" if tag in CONTAINERS else self.at.path, self.at, self.at.dropped or _noise(tag, known, inside), _named_noise(tag, known))
        if tag in CONTAINERS or tag in ("ul", "ol"):
            names = {n.lower() for n in _names(known)}
            node.reactions = bool(names & (REACTIONS | DEBATES))
            # beside the article they are comments in any case
            node.byline = bool(names & REACTIONS) and not inside & {"article", "main"}
        if tag in ("time", "cite") or any(map(BYLINE.search, _names(known))):
            up = self.at
            while up is not None:
                up.byline = up.byline or up.reactions
                up = up.parent
        self.at.children.append(node)
        self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # "/>" ends only void elements

    def _end(self, tags: set[str]) -> None:
        node = self.at
        while node is not self.root:
            if node.tag in tags:
                self.at = node.parent
                return
            if node.tag in SCOPE:
                return
            node = node.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not self.root:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def sized(self) -> list[Node]:
        """All nodes, parents first, with ``size`` (characters of blocks outside
        dropped elements, without those that are mostly links)."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(reversed([c for c in node.children if isinstance(c, Node)]))
        for node in reversed(order):  # all text, to tell layout from boilerplate
            if not node.dropped:
                node.size = sum(len(c.strip()) if isinstance(c, str) else c.size for c in node.children)
                node.main = max([c.main for c in node.children if isinstance(c, Node)] + [node.size if node.tag in ("article", "main") else 0])
        whole = self.root.size
        for node in order:
            holds = whole and (node.size >= SHARE * whole or node.main >= ARTICLE_SHARE * whole)
            node.dropped = node.dropped or ((node.named or (node.reactions and node.byline)) and not holds) or (node.parent is not None and node.parent.dropped)
        for node in reversed(order):
            node.size = node.linked = 0
            if node.dropped:
                continue
            below = 0  # in blocks of their own
            for c in node.children:
                if isinstance(c, str):
                    n = len(c.strip())
                    node.size += n
                    node.linked += n if node.tag == "a" else 0
                elif c.tag in BLOCKS:
                    below += c.size
                else:
                    node.size += c.size
                    below += c.main
                    node.linked += c.size if node.tag == "a" else c.linked
            if node.tag in BLOCKS:
                node.size = below + (node.size if 2 * node.linked <= node.size else 0)
                node.linked = node.main = 0
            else:
                node.main = below
        return order


def best_container(nodes: list[Node]) -> Node:
    """The lowest container that holds all text that counts."""
    node = nodes[0]
    while node.size:
        inner, stack = [], [c for c in node.children if isinstance(c, Node)]
        while stack:
            c = stack.pop()
            if c.dropped:
                continue
            if c.tag in CONTAINERS:
                inner.append(c)
            else:
                stack.extend(x for x in c.children if isinstance(x, Node))
        best = max(inner, key=lambda c: c.size, default=None)
        if best is None or best.size < node.size:
            break
        node = best
    return node


def block_texts(node: Node) -> list[str]:
    """The texts of blocks in page order, white space made single."""
    blocks: list[list[str]] = [[]]
    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        elif not x.dropped or x is node:
            around = x.tag in BLOCKS
            if around:
                blocks.append([])
                stack.append(None)
            stack.extend(reversed(x.children))
    texts = (" ".join("".join(b).split()) for b in blocks)
    return [t for t in texts if t]


def vote(html: str) -> tuple[str, int]:
    nodes = Tree(html).sized()
    best = best_container(nodes)
    return best.path, best.size


def extract(html: str, path: str | None) -> str:
    nodes = Tree(html).sized()
    fits = {id(n): n for n in nodes if n.path == path and n.tag in CONTAINERS and not n.dropped and n.size} if path else {}
    if not fits:
        return "\n\n".join(block_texts(best_container(nodes)))
    around = set()
    for n in fits.values():
        while (n := n.parent) is not None:
            around.add(id(n))
    taken, texts = set(), []
    for n in nodes:  # in page order, parents first
        if n.parent is not None and id(n.parent) in taken:
            taken.add(id(n))
        elif not n.dropped and (id(n) in fits or (n.tag in BESIDE and n.size and n.parent is not None and id(n.parent) in around)):
            taken.add(id(n))
            texts += block_texts(n)
    return "\n\n".join(texts)


def host(url: Column) -> Column:
    """The lower-cased host of a URL, empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): for each host the path with the greatest votes."""
    ship_code()

    def votes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [vote(h) for h in part["html"]]
            yield pd.DataFrame({"host": part["host"], "path": [p for p, _ in found], "weight": [w for _, w in found]})

    cast = pages.select(host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).mapInPandas(votes, "host string, path string, weight long")
    return (cast.filter("weight > 0").groupBy("host", "path").agg(F.sum("weight").alias("weight"))
            .withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("weight"), "path")))
            .filter("place = 1").select("host", "path"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each page.

    A null or empty html, and a page without main text, give an empty text.  A
    null url is of the empty host.  Repeated rows each vote and each come back;
    other columns are not read; an empty table gives no row.  Of paths with
    equal votes the first in order wins.  A page is parsed whole by one task,
    however long it is.

    The winning paths, one for each host, are written first, so that Spark knows
    their size: pages meet them where they lie as long as they can be broadcast,
    and are sorted by host beyond that, where a host with a third of all pages
    is split as a skewed partition."""
    ship_code()

    def texts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [extract(h, p) for h, p in zip(part["html"], part["path"])]
            yield pd.DataFrame({"page_id": part["page_id"].astype("Int64"), "url": part["url"], "text": out, "n_chars": [len(t) for t in out]})

    winners = written(winning_paths(pages), "paths")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("host"))
    return rows.join(winners, "host", "left").select("page_id", "url", "html", "path").mapInPandas(texts, "page_id long, url string, text string, n_chars long")
