"""Abbreviations learnt from the corpus, and sentences that don't end at them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import text as X
from broadsheet.operators.unnest import unnest

# An abbreviation has at most so many letters, stands before a full stop at least so often
# and in at least so many of a hundred cases, and makes up at least one in so many of all
# full stops. The last rule bounds the list, whatever the corpus.
LONGEST, LEAST, PERCENT, MOST = 5, 5, 90, 10_000

# Stands where sentences part while they are put together; Unicode keeps it out of texts.
PARTING = "\uffff"
EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def bare_word(word: Column) -> Column:
    """Lower case, without what is no letter or digit at either end."""
    return F.regexp_replace(F.lower(word), EDGE, "")


def full_stop_stats(articles: DataFrame, text: str = "content") -> DataFrame:
    """(term, before_stop, elsewhere): how often a word stands before a full stop or not.

    Words are parted by white space. They are counted as they stand, and only distinct ones
    are stripped. Counts are summed in each task before the shuffle, so a frequent word is
    no hot key. Missing texts have no words.
    """
    words = unnest(articles, F.split(X.text_of(F.col(text)), r"\s+"), value="word")
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    # a test of the term itself would be pushed below the counting, to every word
    bare = F.filter(F.array(bare_word(F.col("word"))), lambda term: term != "")
    stop = F.endswith("word", F.lit("."))
    return (unnest(counted, bare, "word", "n", value="term").groupBy("term")
            .agg(F.sum(F.when(stop, F.col("n")).otherwise(0)).alias("before_stop"),
                 F.sum(F.when(stop, 0).otherwise(F.col("n"))).alias("elsewhere")))


def with_verdict(stats: DataFrame, longest: int = LONGEST, least: int = LEAST,
                 percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """``is_abbreviation`` by the rules above; words with digits are none.

    The total reads the same counts, column for column, so their shuffle is made once.
    """
    total = F.coalesce(stats.agg(
        (F.sum(F.col("before_stop") + F.col("elsewhere")) - F.sum("elsewhere"))
        .alias("total")).scalar(), F.lit(0))
    stops = F.col("before_stop")
    return stats.withColumn(
        "is_abbreviation",
        (F.length("term") <= longest) & (stops >= least) & ~F.col("term").rlike(r"\p{N}")
        & (100 * stops >= percent * (stops + F.col("elsewhere"))) & (stops * most >= total))


def learn_abbreviations(articles: DataFrame, text: str = "content", **rules) -> list[str]:
    """The abbreviations of a corpus; at most ``most`` of them. The texts are read once."""
    stats = full_stop_stats(articles, text).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = with_verdict(stats, **rules).where("is_abbreviation")
        return sorted(r.term for r in found.select("term").collect())
    finally:
        stats.unpersist()


def joined_sentences(sentences: str, abbreviations: Iterable[str]) -> Column:
    """Sentences of list column ``sentences`` with those ending in an abbreviation and a
    full stop put together with the next one, by a blank. Inside the row, in linear time.
    """
    known = X.sql_list(abbreviations)
    edge = EDGE.replace("\\", "\\\\")
    # the piece after the last blank first, as looking for an end tries every word
    last = r"regexp_replace(substring_index(s, ' ', -1), '(?s)^.*\\s', '')"
    abbreviated = (f"endswith(s, '.') AND "
                   f"coalesce(regexp_replace(lower({last}), '{edge}', '') IN ({known}), false)")
    marked = (f"transform({sentences}, (s, i) -> concat(s, CASE "
              f"WHEN i = size({sentences}) - 1 THEN '' WHEN {abbreviated} THEN ' ' "
              f"ELSE '{PARTING}' END))")
    return F.expr(f"CASE WHEN size({sentences}) = 0 THEN {sentences} "
                  f"ELSE split(array_join({marked}, ''), '{PARTING}') END")


def sentence_table_by(articles: DataFrame, abbreviations: Iterable[str],
                      text: str = "content") -> DataFrame:
    """One row per sentence, ``sent_id`` from 0, where abbreviations end none. No shuffle."""
    rows = articles.select("article_id", X.sentences_of(X.text_of(F.col(text))).alias("_split"))
    return rows.select("article_id", F.posexplode(
        joined_sentences("_split", abbreviations)).alias("sent_id", "sentence"))
