"""Web pages read tag by tag: visible text and anchors, whatever quotes, entities and nesting the page uses.

Pages go through the standard parser in Arrow batches; a page is read once for its text and its anchors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose text nobody sees.
UNSEEN = frozenset({"script", "style", "noscript"})
LINKS = "array<struct<href:string,display_text:string>>"


class _Reader(HTMLParser):
    """Pieces of text in the order of the page, and (href, first piece, piece after the last) of its anchors."""

    def __init__(self, unseen: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.unseen, self.hidden, self.pieces, self.anchors, self.link = unseen, [], [], [], None

    def handle_starttag(self, tag, attrs):
        if tag in self.unseen:
            self.hidden.append(tag)
        href = (dict(attrs).get("href") or "").strip() if tag == "a" else ""
        if href:  # an anchor that is still open ends without a link
            self.link = href, len(self.pieces)

    def handle_startendtag(self, tag, attrs):
        if tag not in self.unseen:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()
        if tag == "a" and self.link:
            self.anchors.append((*self.link, len(self.pieces)))
            self.link = None

    def handle_data(self, data):
        if not self.hidden:
            self.pieces.append(data)


def _read(page: str | None, unseen: frozenset[str]) -> _Reader:
    reader = _Reader(unseen)
    reader.feed(page or "")  # what the page breaks off in, a tag or an entity, is no text
    return reader


#: What is read as it stands, or an ampersand with the closed entity that it begins, if it begins one.
_ENTITY = re.compile(r"(?is)(<!--.*?-->|<(script|style)\b.*?</\2\s*>)|&(#x[0-9a-f]+;|#[0-9]+;|[a-z][a-z0-9]*;)?")


def _closed_only(page: str | None) -> str:
    """The page with the ampersand of entities that are unknown or have no semicolon as a sign of its own."""
    return _ENTITY.sub(lambda m: m[0] if m[1] or (m[3] and (m[3][0] == "#" or m[3] in html5)) else "&amp;" + m[0][1:], page or "")


def _text_of(unseen: frozenset[str], closed: bool):
    @F.pandas_udf("string")
    def text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in pages:
            yield some.map(lambda page: " ".join(x.strip() for x in _read(_closed_only(page) if closed else page, unseen).pieces if x.strip()), na_action=None).astype("string")

    return text


def visible_text(page: Column | str, online: bool = False, closed: bool = False) -> Column:
    """The text of a page, its pieces trimmed and joined by blanks; null is empty. online: text of scripts, styles and noscript blocks counts too.

    closed: entities without a semicolon, as a text that was cut off has them, stay as they are.
    """
    return _text_of(frozenset() if online else UNSEEN, closed)(page)


def page_links(page: Column | str) -> Column:
    """Array of struct href, display_text of the anchors with a target, in the order in which they end; the text of nested elements is joined by blanks."""

    @F.pandas_udf(LINKS)
    def links(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in pages:
            read = [_read(p if isinstance(p, str) else "", frozenset()) for p in some]
            yield pd.Series([[{"href": h, "display_text": " ".join(r.pieces[a:b]).strip()} for h, a, b in r.anchors] for r in read], dtype="object")

    return links(page)
