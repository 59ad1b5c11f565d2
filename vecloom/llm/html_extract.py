"""Main text of web pages by consensus host paths.

Each page's containers are scored and the page votes for the generalised path (tags
and classes from the root) of the best one; Spark counts the votes of each host; pages
are extracted again by their host's winning path, or by their own where it isn't there.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, with_computed, without

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"']++)*+)>|<[!?][^>]*>""", re.S)
#: What is left to look for where no tag ends any more: a comment.
TOKEN_OPEN = re.compile(r"<!--.*", re.S)
CLASS = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
CLASS_ONLY = re.compile(r"""(?:^|[\s"'/])class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
#: Their content isn't markup.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "canvas"}
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CONTAINERS = set("html body div article section main td aside nav header footer form blockquote center table dialog".split())
#: Never part of an article, by tag and by a word of class, id or role.
CHROME_TAGS = set("nav footer aside form menu dialog button select option head".split())
CHROME_WORDS = set("ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation menu sidebar sidebars aside comment comments reply replies disqus cookie cookies consent gdpr notice notices notification alert footer foot masthead breadcrumb breadcrumbs share sharing social related recommended subscribe subscription newsletter popup modal overlay widget login signin signup search toolbar skip complementary contentinfo".split())
#: A page's own header, unless it is an article's.
HEADER_WORDS = {"header", "topbar", "banner"}
#: A start tag in the first set ends an open element of the second without an end tag.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("ul ol dl table div article section main aside nav header footer form body".split())
#: Share of a page's text that a container must hold to be its main one.
SHARE = 0.6
#: Share of its page's best container that a host's path must cover, and, where most of the host's pages voted for it, TRUSTED at least, the share of its text that it must hold.
COVERED, TRUSTED, LEAST = 0.98, 3, 0.1
#: Winning paths of so many characters in all are broadcast; beyond that pages are shuffled to them.
BROADCAST_CHARS = 8 << 20


@dataclass(slots=True)
class Node:
    """A container, or chrome. Its path is held as its last part and a number for the whole, so that nested ones take no more memory than others."""

    tag: str
    part: str
    number: int
    parent: Node | None
    chrome: bool
    in_article: bool
    at: int = 0  # place among the page's nodes: those below it come next, up to last
    last: int = 0
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # number on the page, text, characters in links
    text: float = 0.0
    depth: int = 0

    def path(self) -> str:
        parts, up = [], self
        while up is not None and up.parent is not None:
            parts.append(up.part)
            up = up.parent
        return "".join(">" + p for p in reversed(parts))


def path_number(above: int, part: str) -> int:
    """A number for a path, from that of the path above."""
    return int.from_bytes(hashlib.blake2b(above.to_bytes(8, "little") + part.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Open:
    """The open elements, with the places of each tag among them, of those that end a search upwards, and of those that aren't inline."""

    def __init__(self, root: Node):
        self.tags, self.owner = [""], [root]
        self.places: dict[str, list[int]] = {}
        self.scopes, self.blocks = [-1], [0]

    def push(self, tag: str, owner: Node) -> None:
        at = len(self.tags)
        self.tags.append(tag)
        self.owner.append(owner)
        self.places.setdefault(tag, []).append(at)
        if tag in SCOPE:
            self.scopes.append(at)
        if tag not in INLINE:
            self.blocks.append(at)

    def cut(self, size: int) -> None:
        while len(self.tags) > size:
            tag = self.tags.pop()
            self.owner.pop()
            self.places[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()
            if tag not in INLINE:
                self.blocks.pop()

    def last(self, tag: str) -> int:
        """The place of the innermost open element of a tag, -1 if there is none."""
        places = self.places.get(tag)
        return places[-1] if places else -1


def words_in(attributes: str) -> set[str]:
    return {w for m in CLASS.finditer(attributes) for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower()) if w}


def parse(page: str) -> list[Node]:
    """The containers of a page, in page order, with the text blocks that stand right in them. Time and memory follow the page's size, however it is nested."""
    root = Node("", "", 0, None, False, False)
    nodes, opened = [root], Open(root)
    buffer: list[str] = []
    number = linked = 0
    last_end = page.rfind(">")

    def flush() -> None:
        nonlocal number, linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                opened.owner[-1].blocks.append((number, text, min(linked, len(text))))
                number += 1
        linked = 0

    at, n = 0, len(page)
    while at < n:
        match = (TOKEN if at <= last_end else TOKEN_OPEN).search(page, at)
        end = match.start() if match else n
        if end > at and not opened.owner[-1].chrome:
            part = page[at:end]
            buffer.append(part)
            if opened.last("a") >= 0:
                linked += len(part)
        if not match:
            break
        at = match.end()
        if match.re is TOKEN_OPEN or match[2] is None:
            continue
        tag, attributes = match[2].lower(), match[3]
        where = opened.last(tag)
        if match[1]:
            if tag in INLINE:
                if where >= 0 and opened.blocks[-1] < where:
                    opened.cut(where)
                continue
            flush()
            if where > 0 and (tag in SCOPE or opened.scopes[-1] < where):
                opened.cut(where)
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                stop = RAW_END[tag].search(page, at)
                at = stop.end() if stop else n
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag not in INLINE:
            flush()
            if opened.last("p") > opened.scopes[-1]:
                opened.cut(opened.last("p"))
            ended = max(map(opened.last, CLOSES.get(tag, ())), default=-1)
            if ended > opened.scopes[-1]:
                opened.cut(ended)
        up = opened.owner[-1]
        words = words_in(attributes) if attributes and "=" in attributes else set()
        in_article = up.in_article or tag in ("article", "main")
        chrome = up.chrome or tag in CHROME_TAGS or bool(attributes and HIDDEN.search(attributes)) or (tag not in ("html", "body", "article", "main") and bool(words & CHROME_WORDS)) or bool(words & {"comment", "comments"}) or (not up.in_article and (tag == "header" or bool(words & HEADER_WORDS) and tag not in ("html", "body")))
        if tag in CONTAINERS or chrome != up.chrome:
            m = CLASS_ONLY.search(attributes or "")
            classes = "".join(sorted("." + re.sub(r"\d+", "N", c.replace(">", "")) for c in (m[1] or m[2] or m[3] or "").lower().split())) if m else ""
            part = f"{tag.replace('>', '')}{classes}"
            up = Node(tag, part, path_number(up.number, part), up, chrome, in_article, len(nodes), depth=up.depth + 1)
            nodes.append(up)
        opened.push(tag, up)
    flush()
    for node in reversed(nodes):
        node.last = max(node.last, node.at)
        if node.parent is not None:
            node.parent.last = max(node.parent.last, node.last)
    return nodes


def scored(nodes: list[Node]) -> Node | None:
    """The best container: articles first, else the deepest that holds SHARE of the page's text that is no link, or
    the nearest above it that holds all of it."""
    for node in nodes:
        node.text = 0.0
    for node in reversed(nodes):  # what is below comes first
        if not node.chrome:
            node.text += sum(max(0, len(text) - 2 * linked) for _, text, linked in node.blocks)
        if node.parent is not None:
            node.parent.text += node.text
    total = nodes[0].text
    if not total:
        return None
    good = [x for x in nodes if not x.chrome and x.text > 0]
    articles = [x for x in good if x.tag in ("article", "main")]
    if articles:
        best = max(articles, key=lambda x: (x.text, x.depth))
        if best.text >= 0.2 * total:
            return best
    best = max((x for x in good if x.text >= SHARE * total), key=lambda x: x.depth, default=nodes[0])
    up = best.parent
    while up is not None:
        if up.text > best.text:
            best = up
        up = up.parent
    return best


def covered(best: Node, chosen: list[Node]) -> float:
    """Text of best that lies in the chosen containers, of which none is in another."""
    if any(x.at <= best.at <= x.last for x in chosen):
        return best.text
    return sum(x.text for x in chosen if best.at <= x.at <= best.last)


def text_of(nodes: list[Node], chosen: list[Node]) -> str:
    """The blocks below the chosen containers, without chrome, in page order."""
    taken = bytearray(len(nodes))
    for x in chosen:
        taken[x.at] = 1
    blocks = []
    for node in nodes:
        if node.parent is not None and taken[node.parent.at]:
            taken[node.at] = 1
        if taken[node.at] and not node.chrome:
            blocks += node.blocks
    return "\n".join(text for _, text, _ in sorted(blocks))


def outermost(nodes: list[Node]) -> list[Node]:
    """Of nodes in page order those that are in no other."""
    out: list[Node] = []
    for x in nodes:
        if not out or x.at > out[-1].last:
            out.append(x)
    return out


def vote(page: str | None) -> tuple[str, float]:
    """The path of a page's best container and the weight of its vote; no text, no path."""
    nodes = parse(page or "")
    best = scored(nodes)
    return (best.path(), math.log2(1 + best.text)) if best else ("", 0.0)


def extract(page: str | None, path: str | None, trusted: bool = False) -> str:
    """The page's text by its host's path. A path that most of a host's pages voted for (trusted) decides where it
    holds LEAST of the text of the page's own best container; another one, where it covers that. Else the page's own is taken."""
    nodes = parse(page or "")
    best = scored(nodes)
    if best is None:  # links alone: there is no better text
        return text_of(nodes, [nodes[0]])
    chosen = []
    if path is not None:
        number = 0
        for part in path.split(">")[1:]:
            number = path_number(number, part)
        chosen = outermost([x for x in nodes if x.parent is not None and x.number == number and not x.chrome and x.text > 0])
    held = sum(x.text for x in chosen)
    if not chosen or not (covered(best, chosen) >= COVERED * best.text or (trusted and held >= LEAST * best.text)):
        chosen = [best]
    return text_of(nodes, chosen)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def extract_main_text(df: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """df with text (the article's blocks, joined by newlines) and n_chars.

    A null or empty page, or one without text, gives the empty text. Pages without a host
    vote together. Of paths with equal votes the one of more weight wins, then the one first in
    order. Columns of these names are replaced; every row is kept, repeated rows too. All
    votes are counted; a host with very many pages is summed in each task first. A path that at least TRUSTED pages and most
    of the host's voted for decides what is a page's article even where another container of it holds more.
    """
    keep = without(df, ("text", "n_chars"))
    pages = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{html_col}`").alias("__html"), host_of(F.col(f"`{url_col}`")).alias("__host"))

    def make_vote():
        def kernel(pages):
            paths, weights = zip(*(vote(p.as_py()) for p in pages))
            return [pa.array(paths, pa.string()), pa.array(weights, pa.float64())]

        return kernel

    votes = with_computed(pages.select("__host", "__html"), ["__html"], "path string, weight double", make_vote).filter("path <> ''")
    counted = votes.groupBy("__host", "path").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    best = F.min(F.struct((-F.col("n")).alias("n"), (-F.round("w", 6)).alias("w"), "path"))
    won = counted.groupBy("__host").agg(best.alias("b"), F.sum("n").alias("all"))
    trusted = (-F.col("b.n") >= TRUSTED) & (-2 * F.col("b.n") > F.col("all"))
    winners = won.select("__host", F.col("b.path").alias("__path"), trusted.alias("__trusted"))

    def make_extract():
        def kernel(pages, paths, trusted):
            texts = [extract(p.as_py(), path.as_py(), bool(t.as_py())) for p, path, t in zip(pages, paths, trusted)]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return kernel

    winners = cut(winners)  # else both passes would vote
    size = winners.agg(F.coalesce(F.sum(F.length("__host") + F.length("__path")), F.lit(0))).first()[0]
    joined = pages.join(F.broadcast(winners) if size <= BROADCAST_CHARS else winners, "__host", "left")
    return with_computed(joined, ["__html", "__path", "__trusted"], "text string, n_chars long", make_extract).drop("__html", "__path", "__trusted", "__host")
