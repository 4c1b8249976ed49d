"""Sentence and token tables, and which articles are refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import text as X
from broadsheet.functions.predicates import has_text
from broadsheet.operators.unnest import unnest


def sentence_table(articles: DataFrame, text: str = "content",
                   *keep: str) -> DataFrame:
    """One row per sentence, ``sent_id`` from 0. No shuffle."""
    split = F.posexplode(X.sentences_of(X.text_of(F.col(text))))
    return articles.select("article_id", *keep, split.alias("sent_id", "sentence"))


def token_table(sentences: DataFrame, *keep: str) -> DataFrame:
    """One row per distinct term of a sentence. No shuffle."""
    return unnest(sentences, X.token_set(F.col("sentence")),
                  "article_id", "sent_id", *keep, value="term")


def sentence_counts(articles: DataFrame, text: str = "content") -> DataFrame:
    """Sentences per article, zero included. Counted inside the row."""
    count = F.size(X.sentences_of(X.text_of(F.col(text))))
    return articles.select("article_id", count.alias("total_sentences"))


def rejected_articles(articles: DataFrame, text: str = "content") -> DataFrame:
    """Articles that cannot be analysed, each with the reason.

    A text without a character is refused as blank; one that loses everything
    when folded to ASCII has no sentence left.
    """
    column = X.text_of(F.col(text))
    reason = (F.when(~has_text(column), "no_text")
              .when(~X.has_folded_text(column), "no_sentences"))
    return (articles.select("article_id", reason.alias("reason"))
            .filter(F.col("reason").isNotNull()))
