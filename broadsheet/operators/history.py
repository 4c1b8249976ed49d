"""The analysis history: one owner's rows, order, defaults, older shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet import constants as C
from broadsheet.functions import fields as N
from broadsheet.functions import scores as S
from broadsheet.operators.ranks import RANGE_ROWS, rank_within
from broadsheet.operators.unnest import unnest


def parsed_date(column: Column) -> Column:
    return F.try_to_timestamp(column, F.lit(C.HISTORY_DATE_FORMAT))


def history_of(history: DataFrame, email: str) -> DataFrame:
    """One owner's records; on the history table this prunes to the owner's bucket."""
    mine = history.filter(F.col("email") == email)
    if "owner_bucket" not in history.columns:
        return mine
    bucket = F.pmod(F.xxhash64(F.lit(email)), F.lit(C.OWNER_BUCKETS)).cast("int")
    return mine.filter(F.col("owner_bucket") == bucket).drop("owner_bucket")


def newest_first(history: DataFrame, *tie_break: str) -> DataFrame:
    """Global order by date, newest first. A range sort, so it spreads."""
    return history.orderBy(parsed_date(F.col("date")).desc(), *tie_break)


def rank_by_date(history: DataFrame, tie_break: str,
                 range_rows: int = RANGE_ROWS) -> DataFrame:
    """``recency`` 1.. per owner, newest first, for owners of any size.

    Rows without a date come last; equal dates go by the tie-break. An owner of more than
    ``range_rows`` rows is ranked in ranges of date and tie-break, even where all its rows
    are of one second (see ``rank_within``).
    """
    when = F.col("recorded_at")
    dated = history.withColumn("recorded_at", parsed_date(F.col("date")))
    order = F.struct(when.isNull().alias("undated"), (-F.unix_micros(when)).alias("age"),
                     F.col(tie_break).alias("tie"))
    return rank_within(dated, ["email"], order, "recency", range_rows)


def with_display_defaults(history: DataFrame) -> DataFrame:
    """Every missing field as it is shown."""
    filled = {}
    for name, default in C.DISPLAY_DEFAULTS.items():
        column = F.col(name) if name in history.columns else F.lit(None)
        filled[name] = F.coalesce(column, F.lit(default))
    return history.withColumns(filled)


def union_histories(*histories: DataFrame) -> DataFrame:
    """Append histories; a column one of them lacks is NULL there."""
    first, *others = histories
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def technique_rows(history: DataFrame, *keep: str) -> DataFrame:
    """Older records: parallel technique and score lists as rows."""
    sentences = unnest(history, "propaganda_sentences", *keep, pos="pos", value="item")
    pairs = F.arrays_zip(F.col("item.detected_techniques").alias("technique"),
                         F.col("item.scores").alias("score"))
    return (unnest(sentences, pairs, *keep, "pos",
                   F.col("item.sentence").alias("sentence"), value="pair")
            .select(*keep, "pos", "sentence",
                    F.col("pair.technique").alias("technique"),
                    F.col("pair.score").alias("score")))


def export_rows(history: DataFrame, *keep: str) -> DataFrame:
    """The ten columns of the CSV export and the file name."""
    def given(name, default):
        return F.coalesce(F.col(name), F.lit(default))

    return history.select(
        *keep,
        given("title", C.EXPORT_TITLE).alias("Title"),
        given("date", "").alias("Date"),
        given("email", C.DEFAULT_OWNER).alias("Analyzed By"),
        given("sentiment_score", 3.0).alias("Sentiment Score"),
        given("sentiment_label", "Neutral").alias("Sentiment Label"),
        given("bias_score", 0).alias("Bias Count"),
        given("propaganda_score", 0).alias("Propaganda Count"),
        given("final_score", 0.0).alias("Final Score"),
        N.json_text(F.col("biased_sentences")).alias("Biased Sentences"),
        N.json_text(F.col("propaganda_sentences")).alias("Propaganda Sentences"),
        F.concat(N.file_stem(F.col("title")), F.lit(".csv")).alias("file_name"))


def export_file_names(history: DataFrame, *tie_break: str,
                      range_rows: int = RANGE_ROWS) -> DataFrame:
    """``file_name`` of each record's own export file; no two records share one.

    Of records whose titles give one name, upper and lower case taken as equal, the oldest
    has the plain name, the next ``name (2).csv`` and so on, by date and then by
    ``tie_break`` or, without any, by a hash of the record. A plain name holds no blank, so
    a numbered one is never that of another title. Titles that very many records share
    are numbered in ranges.
    """
    ties = [F.col(c) for c in tie_break] or [F.xxhash64(*history.columns)]
    name = N.safe_file_name(N.file_stem(F.col("title")))
    order = F.struct(F.coalesce("date", F.lit("")).alias("date"),
                     *(t.alias(f"tie{i}") for i, t in enumerate(ties)))
    named = rank_within(history.withColumn("_name", name).withColumn("_key", F.lower("_name")),
                        ["_key"], order, "_nth", range_rows)
    number = F.when(F.col("_nth") == 1, "").otherwise(
        F.concat(F.lit(" ("), F.col("_nth").cast("string"), F.lit(")")))
    return named.withColumn("file_name", F.concat("_name", number, F.lit(".csv"))).drop(
        "_name", "_key", "_nth")


def display_scores(history: DataFrame) -> DataFrame:
    """Scores as shown: two decimals, and the colour of the label."""
    return history.withColumns({
        "sentiment_text": S.two_decimals(F.col("sentiment_score")),
        "final_text": S.two_decimals(F.col("final_score")),
        "sentiment_color": S.sentiment_color(F.col("sentiment_label")),
    })


def valid_feedback(entries: DataFrame) -> DataFrame:
    """Feedback with some text in it; the owner is ``guest`` when unknown."""
    return (entries.filter(F.coalesce(F.trim("feedback") != "", F.lit(False)))
            .withColumn("email", F.coalesce("email", F.lit(C.DEFAULT_OWNER))))
