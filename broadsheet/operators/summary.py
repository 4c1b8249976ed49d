"""Corpus summary: how many articles are flagged, and which topics there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet import constants as C


def flag_counts(flagged: DataFrame, flag: str = "is_propaganda") -> DataFrame:
    """Always one row; a side without articles counts 0."""
    yes = F.coalesce(F.col(flag), F.lit(False))
    return flagged.agg(F.count_if(yes).alias("propaganda_articles"),
                       F.count_if(~yes).alias("other_articles"))


def topic_lines(info: DataFrame) -> DataFrame:
    """One row with ``Topic <n>: <name>`` lines; the table has a row per topic."""
    line = F.concat(F.lit("Topic "), F.col("topic").cast("string"), F.lit(": "),
                    F.col("name"))
    ordered = F.array_sort(F.collect_list(F.struct("topic", line.alias("line"))))
    text = F.array_join(ordered["line"], "<br>")
    return info.agg(F.when(F.count("*") > 0, text)
                    .otherwise(C.NO_TOPICS_TEXT).alias("topics_html"))


def report_summary(flagged: DataFrame, info: DataFrame) -> DataFrame:
    """Counts and topic lines in one row."""
    topics: Column = topic_lines(info).scalar()
    return flag_counts(flagged).withColumn("topics_html", topics)
