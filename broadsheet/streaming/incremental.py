"""Analyse articles as they land and append them to the history.

The analysis of an article depends on nothing but the article, so it runs on a
stream as it is: no state, no watermark. Each batch is a run of its own in the history,
named after the checkpoint and its number, so a batch that is tried again replaces itself.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from broadsheet import schemas
from broadsheet.plans.article_analysis import analysis_records, score_articles
from broadsheet.sinks.outputs import append_history


def stream_articles(spark: SparkSession, path: str,
                    schema=schemas.ARTICLES) -> DataFrame:
    """New JSON-lines files under ``path``."""
    return spark.readStream.schema(schema).json(path)


def append_analyses(articles: DataFrame, path: str, checkpoint: str, *,
                    bias_terms, stars, propaganda, **options) -> StreamingQuery:
    """Start the stream; it ends once what has landed is analysed.

    ``checkpoint`` belongs on storage that all nodes share.
    """
    records = analysis_records(score_articles(
        articles, bias_terms=bias_terms, stars=stars, propaganda=propaganda,
        **options))
    name = f"stream-{zlib.crc32(checkpoint.encode()):08x}"

    def save(batch: DataFrame, number: int) -> None:
        append_history(batch, path, run=f"{name}-{number}")
    return (records.writeStream.outputMode("append").foreachBatch(save)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
