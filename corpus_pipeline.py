"""The corpus pipeline: quality, near copies, benchmarks, personal data, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from broadsheet.llm import decontaminate, near_dedup, pii, quality, sentence_pieces
from broadsheet.llm.storage import materialize, short_batches

TOKENIZER = "piece_bpe_32k.model"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score stays under the threshold."""
    short_batches(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, that of the least id."""
    return near_dedup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more stands in benchmark items."""
    return decontaminate.remove_contaminated(
        docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the mark of its kind."""
    return pii.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, with digests of the ids and of the text decoded from them.

    The ids are written in between, so a task has one Python worker at a time, not two.
    """
    short_batches(spark)
    model = public_tokenizers.path(TOKENIZER)
    ids = materialize(sentence_pieces.encode_documents(docs, model), "ids")
    return sentence_pieces.decoded_digests(ids, model)


STAGES = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_dedup_filter),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", token_ids),
]

# Classifier, components and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
