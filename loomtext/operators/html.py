"""Text of HTML pages by a parser: all visible text, or only its article. Arrow UDFs on whole batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_HIDDEN = {"script", "style", "title", "noscript", "template", "head"}
_BLOCKS = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "nav", "table", "tr", "td", "br", "header", "footer", "main", "blockquote", "pre"}


class _Blocks(HTMLParser):
    """Blocks of text with the number of their words inside links, and line marks after paragraphs."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden: list[str] = []
        self.links = 0
        self.blocks: list[tuple[str, int]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.visible: list[str] = []
        self.hrefs: list[str] = []

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((text, self.linked))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _HIDDEN and tag != "head":
            self.hidden.append(tag)
        if tag in _BLOCKS:
            self.end_block()
            self.visible.append(" ")
        if tag == "a":
            self.links += 1
            self.hrefs += [v for k, v in attrs if k == "href" and v]

    def handle_endtag(self, tag: str) -> None:
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()
        if tag in _BLOCKS:
            self.end_block()
            self.visible.append("\n" if tag == "p" else " ")
        if tag == "a":
            self.links = max(0, self.links - 1)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)
            self.visible.append(" ".join(re.split(r"[\n\r]", data)))
            if self.links:
                self.linked += len(data.split())


def _parsed(html: str) -> _Blocks:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.end_block()
    return parser


def visible_text(html: str) -> str:
    """Visible text, white space collapsed, a line for each paragraph, without blank lines at its end."""
    lines = ("".join(_parsed(html).visible)).split("\n")
    return "\n".join(" ".join(x.split()) for x in lines).strip()


def article_text(html: str, least: int = 8, linked: float = 0.33) -> str:
    """Blocks of at least ``least`` words of which at most a share of ``linked`` are links."""
    return "\n".join(t for t, n in _parsed(html).blocks if (k := len(t.split())) >= least and n <= linked * k)


def links(html: str) -> list[str]:
    return _parsed(html).hrefs


def _udf(function, kind: str):
    @F.pandas_udf(kind)
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: function(h) if h is not None else None)

    return run


def html_text(html: Column) -> Column:
    return _udf(visible_text, "string")(html)


def html_article(html: Column) -> Column:
    return _udf(article_text, "string")(html)


def html_links(html: Column) -> Column:
    return _udf(links, "array<string>")(html)
