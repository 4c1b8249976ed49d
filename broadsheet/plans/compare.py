"""Comparing the articles of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet import constants as C
from broadsheet.functions import scores as S

FIGURES = ("sentiment_score", "bias_count", "propaganda_count", "final_score")


def comparable(articles: DataFrame, batch: str = "batch_id",
               low: int = C.COMPARE_MIN, high: int | None = None) -> DataFrame:
    """Articles of batches of at least ``low`` articles, and at most ``high`` if given.

    Sizes are counted with a partial aggregate; the semi join then drops the
    others before any text is analysed. ``refused`` names what was dropped.
    """
    return articles.join(_sizes(articles, batch, low, high).filter("reason IS NULL"),
                         batch, "left_semi")


def refused(articles: DataFrame, batch: str = "batch_id",
            low: int = C.COMPARE_MIN, high: int | None = None) -> DataFrame:
    """Batches outside the limits: their size and the reason."""
    return _sizes(articles, batch, low, high).filter("reason IS NOT NULL")


def _sizes(articles: DataFrame, batch: str, low: int, high: int | None) -> DataFrame:
    size = F.col("articles")
    reason = F.when(size < low, F.lit(f"fewer than {low} articles"))
    if high is not None:
        reason = reason.when(size > high, F.lit(f"more than {high} articles"))
    return articles.groupBy(batch).agg(F.count("*").alias("articles")).withColumn(
        "reason", reason)


def comparison_table(scored: DataFrame, *keep: str) -> DataFrame:
    """The compared figures plus the display colour of the sentiment."""
    return scored.select(
        *keep,
        F.coalesce("title", F.lit(C.DEFAULT_TITLE)).alias("title"),
        "sentiment_score", "sentiment_label",
        F.col("bias_score").alias("bias_count"),
        F.col("propaganda_score").alias("propaganda_count"),
        "final_score",
        S.sentiment_color(F.col("sentiment_label")).alias("sentiment_color"))


def mark_highest(table: DataFrame, batch: str = "batch_id",
                 figures=FIGURES) -> DataFrame:
    """``is_max_*`` per figure; every tie is marked.

    The maxima are partial aggregates joined back on the batch, so a batch of
    any size is never gathered in one task.
    """
    highest = table.groupBy(F.col(batch).alias("_batch")).agg(
        *[F.max(name).alias(f"_max_{name}") for name in figures])
    joined = table.join(highest, F.col(batch).eqNullSafe(F.col("_batch")))
    return joined.select(*table.columns, *[
        (F.col(name) == F.col(f"_max_{name}")).alias(f"is_max_{name}") for name in figures])
