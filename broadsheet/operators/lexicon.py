"""Finding lexicon terms in sentences, and keeping lexicons up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import text as X
from broadsheet.operators.lookup import Lookup
from broadsheet.operators.unnest import unnest

SENTENCE = ("article_id", "sent_id")


def match_terms(sentences: DataFrame, terms) -> DataFrame:
    """Sentences with at least one of ``terms``; a list held by the driver.

    Whole tokens, case-folded, each term once and sorted. No shuffle: the list
    is part of the plan and is looked up by hash inside each row.
    """
    terms = [term.lower() for term in terms]
    found = X.kept_sql(X.tokens_sql("sentence"), terms)
    return (sentences
            .withColumn("detected_terms",
                        F.expr(f"sort_array(array_distinct({found}))"))
            .filter(F.size("detected_terms") > 0))


def _gather(hits: DataFrame) -> DataFrame:
    """Hits back to one row per sentence; bounded by the sentence's own words."""
    return hits.groupBy(*SENTENCE).agg(
        F.array_sort(F.collect_set("term")).alias("detected_terms"))


def match_lexicon(sentences: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``match_terms`` for a lexicon that is a table of any size.

    A short one becomes part of the plan. For a longer one the words that can't be in it
    are dropped inside the sentence; of the others ids and words meet the lexicon, which
    is sent to them up to a counted size and joined by shuffle beyond. Sentence text
    never moves.
    """
    wanted = lexicon.select(F.lower("term").alias("term"))
    lookup = Lookup.of(wanted)
    if lookup.known is not None:
        return match_terms(sentences, lookup.known)
    return _gather(lookup.join(_kept_tokens(sentences, lookup), lookup.terms, "term"))


def _kept_tokens(sentences: DataFrame, lookup: Lookup, *keep: str) -> DataFrame:
    """One row per distinct word of a sentence that the list may hold."""
    kept = F.filter(X.token_set(F.col("sentence")), lookup.may_hold)
    return unnest(sentences, kept, *SENTENCE, *keep, value="term")


def match_owner_lexicons(sentences: DataFrame, lexicons: DataFrame,
                         default_terms, owners: DataFrame | None = None) -> DataFrame:
    """Each owner's own list on the owner's sentences (column ``owner``).

    Owners without a list get ``default_terms``; an owner with an empty list has
    no hits. ``owners`` names those that have a list, empty ones too; without it
    they are the owners of ``lexicons``. Sentences are read once: every token
    that some list might hold is looked up by owner and term, so an owner with a
    third of all articles still spreads over the terms, and only ids and terms
    move.
    """
    own = lexicons.select("owner", F.lower("term").alias("term")).distinct()
    listed = (lexicons if owners is None else owners).select(
        "owner", F.lit(True).alias("listed")).distinct()
    spark = sentences.sparkSession
    defaults = [t.lower() for t in default_terms]
    default = F.col("term").isin(defaults)
    lookup = Lookup.of(own.select("term").union(
        spark.createDataFrame([(t,) for t in defaults], "term string")))
    found = (_kept_tokens(sentences, lookup, "owner")
             .join(own.withColumn("own", F.lit(True)), ["owner", "term"], "left")
             .filter(F.col("own") | default)
             .join(listed, "owner", "left")
             .filter(F.col("own") | F.col("listed").isNull()))
    return found.groupBy(*SENTENCE, "owner").agg(
        F.array_sort(F.collect_set("term")).alias("detected_terms"))


def bias_counts(articles: DataFrame, terms, text: str = "content") -> DataFrame:
    """Sentences with at least one term, per article, zero included."""
    found = X.kept_sql(X.tokens_sql("s"), [term.lower() for term in terms])
    split = articles.select(
        "article_id", X.sentences_of(X.text_of(F.col(text))).alias("sentences"))
    hit = F.expr(f"filter(sentences, s -> size({found}) > 0)")
    return split.select("article_id", F.size(hit).cast("long").alias("bias_score"))


def term_usage(articles: DataFrame, lexicon: DataFrame,
               text: str = "content") -> DataFrame:
    """For every lexicon term, how many articles use it; unused ones count 0.

    Article words are counted before they meet the lexicon, so the shuffle
    carries one row per term and task.
    """
    used = (unnest(articles, X.token_set(X.text_of(F.col(text))), value="term")
            .groupBy("term").agg(F.count("*").alias("articles")))
    return (lexicon.join(used, "term", "left")
            .withColumn("articles", F.coalesce("articles", F.lit(0))))


# --- Maintenance -------------------------------------------------------------

def add_terms(lexicon: DataFrame, new_terms: DataFrame) -> DataFrame:
    """Which of ``new_terms(owner, pos, term)`` are new: status per distinct term.

    ``added``, ``exists`` (whatever the case) or ``blank``. Of spellings that
    differ in case only the first, by ``pos``, is added.
    """
    asked = new_terms.select("owner", "pos", X.strip_text(F.col("term")).alias("term"),
                             F.lower(X.strip_text(F.col("term"))).alias("key"))
    asked = asked.groupBy("owner", "key").agg(F.min_by("term", "pos").alias("term"))
    present = lexicon.select("owner", F.lower("term").alias("key"),
                             F.lit(True).alias("present")).distinct()
    status = (F.when(F.col("key") == "", "blank")
              .when(F.col("present"), "exists").otherwise("added"))
    return (asked.join(present, ["owner", "key"], "left")
            .select("owner", "term", status.alias("status")))


def extend_lexicon(lexicon: DataFrame, new_terms: DataFrame) -> DataFrame:
    """The lexicon with the added terms appended."""
    added = (add_terms(lexicon, new_terms).filter(F.col("status") == "added")
             .select("owner", "term"))
    return lexicon.select("owner", "term").unionByName(added)


def edit_lexicon(edits: DataFrame) -> DataFrame:
    """Replace lists from text, one term a line (``owner, txt``).

    Blank lines are dropped; of spellings that differ in case only, the first
    stays. ``min_by`` merges before the shuffle, where a ranked window would
    bring every repeat of a term to one task.
    """
    lines = edits.select(
        "owner", F.posexplode(F.split("txt", "\n")).alias("pos", "line"))
    terms = (lines.select("owner", "pos", X.strip_text(F.col("line")).alias("term"))
             .filter(F.col("term") != ""))
    return (terms.groupBy("owner", F.lower("term").alias("key"))
            .agg(F.min_by("term", "pos").alias("term"), F.min("pos").alias("pos"))
            .select("owner", "pos", "term"))


def reset_lexicon(lexicon: DataFrame, owner: str, built_in: DataFrame) -> DataFrame:
    """Drop an owner's list and put the built-in one in its place."""
    others = lexicon.filter(F.col("owner") != owner).select("owner", "term")
    return others.unionByName(
        built_in.select(F.lit(owner).alias("owner"), "term"))
