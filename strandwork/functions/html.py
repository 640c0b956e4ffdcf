"""Main text of HTML pages: a parser of tags with a stack of open elements, and blocks scored by text and links.

Tags are told from text by the parser, so that quotes may hold ``>`` and scripts may hold tags; open elements are a stack on
which an end tag closes what was left open inside it, and a tag without a beginning closes nothing. The text of each block
counts for the elements that hold it, the nearest most; what is mostly links counts for nothing. The element that comes to
most is the main one, and its blocks are the text.
"""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What HTML says of its elements.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BLOCKS = "address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
NO_TEXT = "script style noscript template head svg iframe object select textarea button".split()
ASIDE = "nav aside footer header form".split()
CLOSED_BY_SIBLING = {"p": ["p"], "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr", "td", "th"], "td": ["td", "th"], "th": ["td", "th"], "option": ["option"]}
CLOSES_P = "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()
HOLDERS = "article body div main section".split()
SCOPE = "table ul ol dl td th article section div body".split()
# End of fixed values.

#: Words in the class or id of a block that say that it is not what the page is about.
BESIDE = "ad ads advert advertisement banner breadcrumb comments cookie menu newsletter popup promo related share sidebar sponsor sponsored".split()
#: Elements that say that they are.
MAIN, MORE = ("article", "main"), 3.0
#: Of the text of a block, what the element that holds it gets, and the one that holds that.
SHARES = (1.0, 0.5)
MOST_LINKS = 0.5


class Block:
    """The text directly in an element, without that of blocks within it."""

    def __init__(self, path: tuple[int, ...]):
        self.path, self.pieces, self.linked = path, [], 0

    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


class Page(HTMLParser):
    """Blocks of text with the elements that hold them, and the title."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open: list[tuple[str, int, bool]] = []
        self.named: set[int] = set()
        self.n, self.blocks, self.title, self.written, self.in_title = 0, [], [], [], False
        self.skipped = self.links = 0
        self.now: Block | None = None

    def _push(self, tag: str, attrs) -> None:
        self.n += 1
        names = re.split("[^a-z0-9]+", " ".join(v for k, v in attrs if k in ("class", "id") and v).lower())
        beside = tag in BLOCKS and tag not in ("html", "body", *MAIN) and any(n in BESIDE for n in names)
        self.open.append((tag, self.n, tag in NO_TEXT or tag in ASIDE or beside))
        self.skipped += self.open[-1][2]
        if tag in MAIN:
            self.named.add(self.n)
        self.links += tag == "a"
        if tag in BLOCKS:
            self.now = None

    def _pop_to(self, at: int) -> None:
        for tag, _, skips in self.open[at:]:
            self.skipped -= skips
            self.links -= tag == "a"
            if tag in BLOCKS:
                self.now = None
        del self.open[at:]

    def _close(self, tags: list[str], scope: list[str]) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            tag = self.open[at][0]
            if tag in tags:
                return self._pop_to(at)
            if tag in scope:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        if tag == "body":
            self._close(["head"], [])
        if tag in CLOSES_P:
            self._close(["p"], SCOPE)
        if tag in CLOSED_BY_SIBLING:
            self._close(CLOSED_BY_SIBLING[tag], SCOPE)
        if tag in VOID:
            if self.now is not None:
                self.now.pieces.append(" ")
            return
        self._push(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash closes nothing that is not void

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        self._close([tag], [] if tag in BLOCKS + NO_TEXT else BLOCKS)

    def handle_entityref(self, name):
        self._text(unescape(f"&{name};"), f"&{name};")

    def handle_charref(self, name):
        self._text(unescape(f"&#{name};"), f"&#{name};")

    def handle_data(self, data):
        self._text(data, data)

    def _text(self, data: str, written: str) -> None:
        """Text as it reads, and as the page writes it."""
        if self.in_title:
            self.title.append(data)
            self.written.append(written)
            return
        if self.skipped:
            return
        if self.now is None:
            if not data.strip():
                return
            self.now = Block(tuple(i for tag, i, _ in self.open if tag in HOLDERS))
            self.blocks.append(self.now)
        self.now.pieces.append(data)
        if self.links:
            self.now.linked += len("".join(data.split()))


def closed(html: str) -> str:
    """``html`` with only whole references to characters: an ampersand that begins none, or one that was cut before its
    semicolon, stands for itself."""
    return re.sub(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?", lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else f"&amp;{m[1] or ''}", html)


def read(html: str | None) -> Page:
    """The page, its tags and texts taken apart."""
    page = Page()
    page.feed(closed(html or ""))
    page.rawdata = re.sub(r"(?s)^</?[a-zA-Z].*", "", page.rawdata)  # a tag that the page ends in
    page.close()
    return page


def main_text(html: str | None) -> tuple[str | None, str]:
    """Title and main text, its blocks a line each. Nothing but navigation has no text."""
    return _main(read(html))


def _main(page: Page) -> tuple[str | None, str]:
    scores: dict[int, float] = {}
    kept = []
    for block in page.blocks:
        text = block.text()
        size = len(re.sub(r"\s", "", text))
        if not size or block.linked > MOST_LINKS * size:
            continue
        kept.append((block.path, text))
        for holder, share in zip(reversed(block.path or (0,)), SHARES, strict=False):
            more = MORE if holder in page.named else 1.0
            scores[holder] = scores.get(holder, 0.0) + share * more * (size - block.linked)
    best = max(scores, key=lambda k: (scores[k], -k), default=0)
    title = " ".join("".join(page.title).split())
    return title or None, "\n".join(text for path, text in kept if best in path or not path and best == 0)


def parsed(html: Column) -> Column:
    """``title`` and main ``text`` of a page, and the title as it is ``written``, with its references to characters other
    than that to ``&``; null and empty pages have none of them."""

    def row(html: str | None) -> tuple[str | None, str | None, str]:
        page = read(html)
        title, text = _main(page)
        return title, " ".join("".join(page.written).replace("&amp;", "&").split()) or None, text

    @F.pandas_udf("struct<title: string, written: string, text: string>")
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([row(p) for p in pages], columns=["title", "written", "text"])

    return run(html)
