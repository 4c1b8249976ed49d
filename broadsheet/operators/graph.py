"""The source network: who published what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.fields import or_unknown


def _pairs(articles: DataFrame) -> DataFrame:
    def column(name):
        return or_unknown(F.col(name) if name in articles.columns else F.lit(None))

    return articles.select(column("source").alias("source"),
                           column("article_id").alias("article_id"))


def source_nodes(articles: DataFrame) -> DataFrame:
    """``id, type`` once each; repeats merge in the map-side aggregate."""
    pairs = _pairs(articles)
    sources = pairs.select(F.col("source").alias("id"), F.lit("source").alias("type"))
    return sources.distinct().unionByName(
        pairs.select(F.col("article_id").alias("id"), F.lit("article").alias("type"))
        .distinct())


def source_edges(articles: DataFrame) -> DataFrame:
    """Undirected ``src, dst`` once each, ends in order."""
    pairs = _pairs(articles)
    return pairs.select(
        F.least("source", "article_id").alias("src"),
        F.greatest("source", "article_id").alias("dst")).distinct()
