"""HTML extraction by consensus of a host's pages on where their text is.

Each page scores its containers by the text of the paragraphs in them, less that of
links, and votes on generalised paths of tags and classes.  Spark sums the votes for
each host and path, and every page is extracted again from the containers on the path
with most of its host's votes among all those the page has.  A page without a host uses
its own best container.

Left out wherever they occur: head, scripts, styles, comments, forms, navigation,
asides, footers, page headers, and elements whose class, id or role names a menu, an
advert, a notice, a sidebar or reader comments.  A block's white space becomes single
spaces, and blocks are joined by line feeds.

Null and empty pages give an empty text, as do pages without a container that has
text.  Pages of any length are parsed whole, without recursion.  Repeated rows vote and
are extracted each on their own; an empty table gives an empty one; ties between paths
go to the one that sorts first.  Columns beside html and url do not take part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import free_name, small, stored

#: How elements are classed.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "head title script style noscript template svg math canvas iframe object audio video form button "
    "input select option textarea label fieldset nav menu aside footer dialog".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CONTAINERS = frozenset("article body center div main section td blockquote html".split())
CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
SCOPE = frozenset("ul ol dl table body article section div main".split())
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner breadcrumb breadcrumbs comment "
    "comments commentlist consent cookie cookies dialog disqus footer gdpr header hidden login masthead menu "
    "modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination "
    "paywall popup promo promotion recommended related replies reply respond search share sharing sidebar "
    "signin signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar topbar widget".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
OUTSIDE_BODY = frozenset("html head body title meta link base script style noscript".split())
LEAST_TEXT = 20
#: The paths of so many distinct pages or templates may be broadcast.
BROADCAST_PAGES = 100_000


@dataclass
class Element:
    tag: str
    path: str
    parent: int
    dropped: bool
    linked: bool


@dataclass
class Block:
    """Text of one block: the element it belongs to, its pieces and the links among them."""

    owner: int
    pieces: list[str] = field(default_factory=list)
    link_chars: int = 0

    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


def _named_boilerplate(attributes: dict[str, str | None]) -> bool:
    if (attributes.get("role") or "").lower() in ROLES or "hidden" in attributes:
        return True
    if (attributes.get("aria-hidden") or "").lower() == "true":
        return True
    if "display:none" in (attributes.get("style") or "").replace(" ", "").lower():
        return True
    names = f"{attributes.get('class') or ''} {attributes.get('id') or ''}"
    return any(part.lower() in BOILERPLATE for part in NAME_PARTS.findall(names))


class Page(HTMLParser):
    """The blocks of a page and the elements around them."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.open: list[int] = []
        self.blocks: list[Block] = []
        self.current: Block | None = None
        self.feed(html)
        self.close()
        self.blocks = [block for block in self.blocks if block.text()]

    def _inside(self, *tags: str) -> bool:
        return any(self.elements[i].tag in tags for i in self.open)

    def _close_implied(self, tag: str) -> None:
        if tag in BLOCKS:
            for depth in range(len(self.open) - 1, -1, -1):
                own = self.elements[self.open[depth]].tag
                if own == "p":
                    del self.open[depth:]
                    break
                if own in BLOCKS:
                    break
        closed = CLOSED_BY.get(tag)
        if closed:
            last = None
            for depth in range(len(self.open) - 1, -1, -1):
                own = self.elements[self.open[depth]].tag
                if own in closed:
                    last = depth
                elif own in SCOPE:
                    break
            if last is not None:
                del self.open[last:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._close_implied(tag)
        if not self.open and tag not in OUTSIDE_BODY:
            self.handle_starttag("body", [])
        if tag == "br":
            if self.current:
                self.current.pieces.append(" ")
            return
        if tag in BLOCKS:
            self.current = None
        if tag in VOID:
            return
        attributes = dict(attrs)
        parent = self.open[-1] if self.open else -1
        above = self.elements[parent] if self.open else None
        dropped = (above.dropped if above else False) or tag in DROPPED or (
            tag not in ("html", "body") and _named_boilerplate(attributes)
        )
        if not dropped and tag == "header":
            dropped = not self._inside("article", "main")
        if not dropped and above is not None and tag not in HEADINGS and self._inside("header") and not self._inside(*HEADINGS):
            dropped = tag not in ("div", "hgroup", "span", "a")
        classes = sorted({re.sub(r"\d+", "", name) for name in (attributes.get("class") or "").split()} - {""})
        step = ".".join([tag, *classes])
        path = f"{above.path}/{step}" if above and tag != "body" else step
        linked = tag == "a" or (above.linked if above else False)
        self.elements.append(Element(tag, path, parent, dropped, linked))
        self.open.append(len(self.elements) - 1)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.current = None
        for depth in range(len(self.open) - 1, -1, -1):
            if self.elements[self.open[depth]].tag == tag:
                del self.open[depth:]
                return

    def handle_data(self, data: str) -> None:
        inside = self.open[-1] if self.open else -1
        if inside < 0:
            if not data.strip():
                return
            self.handle_starttag("body", [])
            inside = self.open[-1]
        if self.elements[inside].dropped:
            return
        if self.current is None:
            if not data.strip():
                return
            owner = inside
            while self.elements[owner].tag not in BLOCKS and self.elements[owner].parent >= 0:
                owner = self.elements[owner].parent
            self.current = Block(owner)
            self.blocks.append(self.current)
        self.current.pieces.append(data)
        if self.elements[inside].linked:
            self.current.link_chars += len(" ".join(data.split()))

    def scores(self) -> dict[str, float]:
        """The score of each container path: its paragraphs' text, less that of links."""
        found: dict[str, float] = {}
        for block in self.blocks:
            size = len(block.text())
            worth = max(0, size - 2 * block.link_chars)
            share, at = 1.0, block.owner
            while at >= 0 and share > 0.2:
                element = self.elements[at]
                if element.tag in CONTAINERS:
                    found[element.path] = found.get(element.path, 0.0) + share * (worth if size >= LEAST_TEXT else worth / 4)
                    share /= 2
                at = element.parent
        return found

    def text(self, chosen: str | None) -> str:
        """The blocks in the containers on a path, or in the best one without a path."""
        if chosen is None:
            own = self.scores()
            if not own:
                return ""
            chosen = min(own, key=lambda path: (-own[path], path))
        lines = []
        for block in self.blocks:
            at = block.owner
            while at >= 0 and self.elements[at].path != chosen:
                at = self.elements[at].parent
            if at >= 0:
                lines.append(block.text())
        return "\n".join(lines)


def _parse(html: str | None) -> Page:
    return Page(html or "")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _votes_udf():
    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("vote", T.DoubleType())])))
    def votes(pages: pd.Series) -> pd.Series:
        rows = []
        for html in pages:
            found = _parse(html).scores()
            top = max(found.values(), default=0)
            rows.append([(path, round(score / top, 6)) for path, score in found.items() if score > 0])
        return pd.Series(rows, dtype=object)

    return votes


def _text_udf():
    @F.pandas_udf(T.StringType())
    def extract(pages: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([_parse(html).text(path) for html, path in zip(pages, paths, strict=True)], dtype=object)

    return extract


def page_paths(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``host, html_key, html_key2, path``: for each distinct page of a host the path that
    most of the host's votes go to, among all paths that the page itself has.

    Pages with the same paths are one template: votes meet templates, not pages.
    """
    page = F.col(f"`{html}`")
    scored = pages.select(
        host_of(F.col(f"`{url}`")).alias("host"),
        F.xxhash64(page).alias("html_key"), F.xxhash64(page, F.lit(1)).alias("html_key2"),
        _votes_udf()(page).alias("found"),
    )
    # Pages are parsed once, whatever follows asks of the votes.
    scored = stored(scored, "page-votes").where("host != '' AND size(found) > 0").withColumn("paths", F.col("found.path"))
    scored = scored.withColumns({"template": F.xxhash64("paths"), "template2": F.xxhash64("paths", F.lit(1))})
    votes = scored.select("host", F.inline("found")).groupBy("host", "path").agg(
        F.sum(F.col("vote").cast("decimal(28,6)")).alias("votes")
    )
    template = ["host", "template", "template2"]
    templates = scored.groupBy(*template).agg(F.first("paths").alias("paths"))
    best = (
        templates.select(*template, F.explode("paths").alias("path"))
        .join(votes, ["host", "path"])
        .groupBy(*template)
        .agg(F.min(F.struct((-F.col("votes")).alias("less"), "path"))["path"].alias("path"))
    )
    own = scored.select(*template, "html_key", "html_key2").distinct()
    best = stored(best, "template-paths")
    return own.join(small(best, limit=BROADCAST_PAGES), template).select("host", "html_key", "html_key2", "path")


def extract(pages: DataFrame, html: str = "html", url: str = "url", name: str = "text") -> DataFrame:
    """All rows and columns, and the main text in a column ``name``."""
    page, path = F.col(f"`{html}`"), free_name(pages, "path")
    keys = {
        free_name(pages, "host"): host_of(F.col(f"`{url}`")),
        free_name(pages, "html_key"): F.xxhash64(page),
        free_name(pages, "html_key2"): F.xxhash64(page, F.lit(1)),
    }
    found = stored(page_paths(pages, html, url), "paths-of-pages").toDF(*keys, path)
    joined = pages.withColumns(keys).join(small(found, limit=BROADCAST_PAGES), list(keys), "left")
    return joined.withColumn(name, _text_udf()(page, F.col(f"`{path}`"))).select(*(f"`{c}`" for c in pages.columns if c != name), f"`{name}`")
