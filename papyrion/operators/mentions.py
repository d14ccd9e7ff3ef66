"""Web pages to links, text and citation mentions, with the stdlib's parser in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.text import sentences


class _Reader(HTMLParser):
    """Visible text, links and the texts of elements with an id in one pass."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.parts, self.links = 0, [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript"):
            self.hidden += 1
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)
        self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript") and self.hidden:
            self.hidden -= 1
        self.parts.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def read_page(html: str) -> tuple[str, list[str]]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return " ".join("".join(reader.parts).split()), reader.links


def page_texts(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, text, links) of each page: visible text with white space collapsed, and link targets in order."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            read = [read_page(h) for h in frame["h"]]
            yield pd.DataFrame({"k": frame["k"], "text": [r[0] for r in read], "links": [r[1] for r in read]})

    return pages.select(F.col(key).cast("long").alias("k"), F.col(html).alias("h")).mapInPandas(run, "k long, text string, links array<string>").withColumnRenamed("k", key)


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, href) of anchors with quoted targets, in expressions only."""
    found = F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("pos", "href"))


def sentence_context(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, sentence, previous, following) of each sentence."""
    rows = docs.select(key, F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))
    order = Window.partitionBy(key).orderBy("pos")
    return rows.withColumns({"previous": F.lag("sentence").over(order), "following": F.lead("sentence").over(order)})


def mentions(pages: DataFrame, targets: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, target, href): links to bibliography targets; targets (target, href), joined on the link."""
    return links(pages, key, html).join(targets, "href").select(key, "target", "href", "pos")
