"""Readable text of HTML pages."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements left out, and elements that stand on lines of their own.
DROPPED = {"script", "style", "noscript", "template", "iframe", "object", "embed"}
BLOCK = set(
    "address article aside blockquote br details dialog dd div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section table tr td ul".split()
)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Reader(HTMLParser):
    """Collects lines; text inside ``<pre>`` is kept as written."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.kept: set[int] = set()
        self.words: list[str] = []
        self.gap = False
        self.dropping: list[str] = []
        self.pre = 0
        self.pre_text: list[str] = []

    def _break(self) -> None:
        if self.words:
            self.lines.append(re.sub(r"\s{2,}", " ", "".join(self.words)))
        self.words, self.gap = [], False

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            if tag not in VOID:
                self.dropping.append(tag)
        elif not self.dropping and tag == "pre":
            self._break()
            self.pre += 1
        elif not self.dropping and not self.pre and tag in BLOCK:
            self._break()

    def handle_startendtag(self, tag, attrs):
        if not self.dropping and not self.pre and tag in BLOCK:
            self._break()

    def handle_endtag(self, tag):
        if self.dropping:
            if tag in self.dropping:
                del self.dropping[self.dropping.index(tag) :]
        elif tag == "pre" and self.pre:
            self.pre -= 1
            if self.pre == 0:
                self._close_pre()
        elif not self.pre and tag in BLOCK:
            self._break()

    def handle_data(self, data):
        if self.dropping:
            return
        if self.pre:
            self.pre_text.append(data)
            return
        if not data.strip():
            self.gap = True
            return
        body = data.strip()
        lead = data[: len(data) - len(data.lstrip())]
        tail = data[len(data.rstrip()) :]
        before = " " if self.gap or (lead and lead[-1] not in "\r\n") else ""
        after = " " if tail and tail[0] not in "\r\n" else ""
        self.words.append(before + body + after)
        self.gap = False

    def _close_pre(self) -> None:
        text = "".join(self.pre_text).replace("\r\n", "\n").removeprefix("\n").rstrip()
        self.pre_text = []
        if text:
            self.kept.add(len(self.lines))
            self.lines.append(text)

    def text(self) -> str:
        self.close()
        if self.pre:
            self._close_pre()
        self._break()
        lines = [line if n in self.kept else line.strip() for n, line in enumerate(self.lines)]
        out, blank = [], 0
        for n, line in enumerate(lines):
            blank = 0 if line else blank + 1
            if blank < 2 or n in self.kept:
                out.append(line)
        joined = "\n".join(out)
        return joined if 0 in self.kept else joined.strip()


def page_text(html: str) -> str:
    reader = _Reader()
    reader.feed(re.sub(r"^\s*<!doctype[^>]*>", "", html, flags=re.I))
    return reader.text()


@F.pandas_udf(T.StringType())
def _page_text(pages: pd.Series) -> pd.Series:
    return pages.map(lambda h: None if h is None else page_text(h))


def html_text(html: Column) -> Column:
    return _page_text(html)
