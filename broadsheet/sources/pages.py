"""Landed web pages to articles."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from broadsheet.functions.predicates import has_text, is_url
from broadsheet.session import short_batches

# Fixed patterns of the expression-only extractor.
NOISE = (r"(?is)<script(?:\s[^>]*)?>.*?</script\s*>"
         r"|<style(?:\s[^>]*)?>.*?</style\s*>|<!--.*?-->")
MAIN = r"(?is)<main(?:\s[^>]*)?>(.*?)</main\s*>"
PARAGRAPH = r"(?is)<p(?:\s[^>]*)?>.*?(?:</p\s*>|</article\s*>)"
TAG = r"(?s)<[^>]*>"
BASIC_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"),
                  ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))

VOID_TAGS = frozenset((
    "area base br col embed hr img input link meta param source track wbr").split())
SILENT_TAGS = frozenset(("script", "style", "template"))


class _PageText(HTMLParser):
    """Collects stripped text pieces of the first <main>, and of any <p>."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.main: list[str] = []
        self.paragraphs: list[str] = []
        self.mains_seen = 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID_TAGS:
            return
        if tag == "main" and "main" not in self.open:
            self.mains_seen += 1
        self.open.append(tag)

    def handle_endtag(self, tag):
        # an end tag also closes what was left open inside it
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        piece = data.strip()
        if not piece or not SILENT_TAGS.isdisjoint(self.open):
            return
        if self.mains_seen == 1 and "main" in self.open:
            self.main.append(piece)
        if "p" in self.open:
            self.paragraphs.append(piece)


def _main_text(html: str | None) -> str:
    parser = _PageText()
    parser.feed(html or "")
    parser.close()
    return " ".join(parser.main if parser.mains_seen else parser.paragraphs)


@F.pandas_udf(StringType())
def page_text(html: pd.Series) -> pd.Series:
    """Text of the first <main>, else of all <p>, pieces joined by a blank.

    Markup is read the way a tolerant parser does: unclosed tags end with
    their parent, entities are decoded, scripts and styles are no text. Text in
    nested paragraphs counts once. A worker holds a batch of pages several times over;
    ``short_batches`` bounds them.
    """
    return html.map(_main_text)


def page_text_by_pattern(html: Column) -> Column:
    """The same idea in expressions only, for mostly well-formed pages.

    A paragraph here runs from ``<p>`` to the next ``</p>``, so text between an
    unclosed paragraph's end and the end of its parent is left out; only the
    common entities are decoded.
    """
    clean = F.regexp_replace(html, NOISE, " ")
    has_main = clean.rlike(MAIN)
    body = F.when(has_main, F.regexp_extract(clean, MAIN, 1)).otherwise(
        F.array_join(F.regexp_extract_all(clean, F.lit(PARAGRAPH), F.lit(0)), " "))
    text = F.regexp_replace(body, TAG, " ")
    for entity, char in BASIC_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def page_articles(pages: DataFrame, *, extract=page_text) -> DataFrame:
    """Every page with its article text and, if it is unusable, the reason.

    Expects ``page_id, url, html`` and, optionally, the crawl's ``status``.
    Pages refused for their URL or status are not parsed at all.
    """
    short_batches(pages.sparkSession)
    refused = F.when(~is_url(F.col("url")), "invalid_url")
    if "status" in pages.columns:
        refused = refused.when(
            ~F.coalesce(F.col("status") == 200, F.lit(False)), "http_error")
    checked = pages.withColumn("refused", refused)
    content = extract(F.when(F.col("refused").isNull(), F.col("html")))
    reason = F.coalesce(F.col("refused"),
                        F.when(~has_text(F.col("content")), "no_content"))
    return (checked.select("page_id", "url", "refused", content.alias("content"))
            .select("page_id", "url", "content", reason.alias("reason")))


def usable(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("reason").isNull()).drop("reason")
