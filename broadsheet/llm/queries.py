"""One query per operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import (
    decontaminate,
    fingerprint,
    near_dedup,
    oracles,
    packing,
    pages,
    pii,
    quality,
    runs,
    search,
    sentence_pieces,
    substrings,
    token_counts,
    token_files,
)
from broadsheet.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


def documents(spark, sf):
    return read_table(spark, f"{sf}/documents.parquet", "doc_id", "text")


@query("op1_fingerprint")
def op1_fingerprint(spark, sf):
    return fingerprint.fingerprint_report(documents(spark, sf))


@query("op2_main_text")
def op2_main_text(spark, sf):
    return pages.extract_pages(
        read_table(spark, f"{sf}/pages.parquet", "page_id", "url", "html"))


@query("op3_quality")
def op3_quality(spark, sf):
    return quality.quality_report(
        documents(spark, sf), read_table(spark, f"{sf}/labels.parquet", "doc_id", "quality"))


@query("op4_pii")
def op4_pii(spark, sf):
    return pii.pii_digest(documents(spark, sf))


@query("op5_near_dedup", oracles.NEAR_DEDUP)
def op5_near_dedup(spark, sf):
    return near_dedup.near_duplicates(documents(spark, sf)).drop("doc")


@query("op6_token_files")
def op6_token_files(spark, sf):
    return token_files.token_report(
        documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_token_counts")
def op7_token_counts(spark, sf):
    return token_counts.section_tokens(
        documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_decontamination", oracles.DECONTAMINATION)
def op8_decontamination(spark, sf):
    return decontaminate.contamination(
        documents(spark, sf),
        read_table(spark, f"{sf}/benchmark.parquet", "item_id", "text")).drop("doc")


@query("op10_substring_dedup", oracles.SUBSTRINGS)
def op10_substring_dedup(spark, sf):
    return substrings.substring_dedup(documents(spark, sf))


@query("op9_sentence_pieces")
def op9_sentence_pieces(spark, sf):
    return sentence_pieces.token_digest(
        documents(spark, sf), public_tokenizers.path("piece_bpe_32k.model"))


@query("op11_ranked_search", oracles.RANKED_SEARCH)
def op11_ranked_search(spark, sf):
    return search.rank_documents(
        documents(spark, sf), read_table(spark, f"{sf}/benchmark.parquet", "item_id", "text"))


@query("op12_packing")
def op12_packing(spark, sf):
    return packing.pack_documents(
        documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """The texts of the contract: a tenth of them repeat some of their words to the end.

    Which, from where and how often is told by the CRC-32 of the id (null: of nothing).
    """
    crc = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # Inside a lambda a column would be computed anew for each word; its argument is not.
    held = F.array(F.struct(words.alias("w"), F.floor(crc / 10).alias("g")))
    planted = F.transform(held, lambda h: F.when(F.size(h["w"]) > 0, F.transform(
        F.array(F.struct(h["w"].alias("w"), (h["g"] % F.size(h["w"])).alias("a"),
                         (1 + F.floor((F.size(h["w"]) - h["g"] % F.size(h["w"]))
                                      / (3 + h["g"] % 8))).alias("p"))),
        lambda k: F.array_join(F.transform(
            k["w"], lambda word, i: F.when(i < k["a"], word).otherwise(
                F.get(k["w"], (k["a"] + (i - k["a"]) % k["p"]).cast("int")))), " "))[0]))[0]
    return docs.select("doc_id", F.when(
        F.col("text").isNotNull() & (crc % 10 == 0), planted).otherwise(F.col("text"))
        .alias("text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf):
    return runs.run_digest(runs.collapse_runs(with_planted_periods(documents(spark, sf))))
