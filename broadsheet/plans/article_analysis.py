"""The article analysis: sentiment, loaded terms, propaganda, one score.

Everything about an article is computed inside its own row: the sentence list,
the terms and labels per sentence, and the totals. The job is a map over the
scan with no shuffle, whatever the size of the corpus or of one source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet import constants as C
from broadsheet.functions import scores as S
from broadsheet.functions import text as X
from broadsheet.functions.predicates import is_propaganda
from broadsheet.operators.scorers import ModelScorer


def _scored(scorer) -> Column:
    if isinstance(scorer, ModelScorer):
        return scorer.score_list(F.col("sentences"))
    return F.expr(f"transform(hits, h -> {scorer.score('h')})")


def sentence_lists(articles: DataFrame, *, bias_terms, stars, propaganda,
                   fold: bool = True, text: str = "content") -> DataFrame:
    """Articles with parallel per-sentence lists.

    Adds ``text``, ``sentences``, ``bias_hits``, ``star_scores`` and
    ``propaganda_scores``. Articles without a sentence are left out here, as
    they have no score (``rejected_articles`` lists them). One pass over the
    tokens finds the terms of all lists together.
    """
    bias_terms = sorted({term.lower() for term in bias_terms})
    wanted = set(bias_terms)
    for scorer in (stars, propaganda):
        if not isinstance(scorer, ModelScorer):
            wanted |= scorer.vocabulary
    body = X.text_of(F.col(text))
    # tested on the input column: a filter on the folded text would be pushed
    # down with a second copy of the whole fold
    kept = articles.filter(
        X.has_folded_text(body) if fold else X.strip_text(body) != "")
    folded = kept.withColumn("text", X.ascii_fold(body) if fold else body)
    split = folded.withColumn("sentences", X.sentences_of(F.col("text")))
    found = X.kept_sql(X.tokens_sql("s"), wanted)
    hits = split.withColumn(
        "hits", F.expr(f"transform(sentences, s -> array_distinct({found}))"))
    return hits.withColumns({
        "bias_hits": F.expr(
            f"transform(hits, h -> sort_array({X.kept_sql('h', bias_terms)}))"),
        "star_scores": _scored(stars),
        "propaganda_scores": _scored(propaganda),
    }).drop("hits")


def article_totals(lists: DataFrame,
                   threshold: float = C.PROPAGANDA_THRESHOLD) -> DataFrame:
    """Counts, mean sentiment, label and final score from the lists."""
    total = F.size("sentences")
    star_sum = F.aggregate("star_scores", F.lit(0),
                           lambda n, s: n + S.star_value(s["label"]))
    biased = F.size(F.filter("bias_hits", lambda h: F.size(h) > 0))
    flagged = F.size(F.filter(
        "propaganda_scores",
        lambda p: is_propaganda(p["label"], p["score"], threshold)))
    counted = lists.withColumns({
        "total_sentences": total,
        "mean_stars": star_sum / total,
        "bias_score": biased.cast("long"),
        "propaganda_score": flagged.cast("long"),
    }).withColumn("sentiment_score", S.round_cents(F.col("mean_stars")))
    return counted.withColumns({
        "sentiment_label": S.sentiment_class(F.col("sentiment_score")),
        "final_score": S.final_score(
            F.col("sentiment_score"), F.col("bias_score"),
            F.col("propaganda_score"), F.col("total_sentences")),
    }).drop("mean_stars")


def article_details(lists: DataFrame,
                    threshold: float = C.PROPAGANDA_THRESHOLD) -> DataFrame:
    """The nested lists of a record, in sentence order."""
    biased = F.filter(
        F.zip_with("sentences", "bias_hits", lambda s, h: F.struct(
            s.alias("sentence"), h.alias("detected_terms"))),
        lambda b: F.size(b["detected_terms"]) > 0)
    flagged = F.filter(
        F.zip_with("sentences", "propaganda_scores", lambda s, p: F.struct(
            s.alias("sentence"), p["score"].alias("score"),
            p["label"].alias("label"))),
        lambda p: is_propaganda(p["label"], p["score"], threshold))
    return lists.withColumns({"biased_sentences": biased,
                              "propaganda_sentences": flagged})


def score_articles(articles: DataFrame, *, bias_terms, stars, propaganda,
                   fold: bool = True, text: str = "content",
                   threshold: float = C.PROPAGANDA_THRESHOLD) -> DataFrame:
    """Input columns plus every figure and detail of the analysis."""
    lists = sentence_lists(articles, bias_terms=bias_terms, stars=stars,
                           propaganda=propaganda, fold=fold, text=text)
    detailed = article_details(article_totals(lists, threshold), threshold)
    return detailed.drop("sentences", "bias_hits", "star_scores",
                         "propaganda_scores")


def analysis_records(scored: DataFrame, analyzed_at: Column | None = None,
                     *keep: str) -> DataFrame:
    """The record that is stored: eleven fields, owner and title defaulted.

    ``analyzed_at`` is a parameter so that a repeated run writes the same rows;
    it defaults to the start time of the job.
    """
    when = analyzed_at if analyzed_at is not None else F.current_timestamp()

    def given(name: str, default: str) -> Column:
        column = F.col(name) if name in scored.columns else F.lit(None)
        return F.coalesce(column.cast("string"), F.lit(default))

    return scored.select(
        *keep,
        given("title", C.DEFAULT_TITLE).alias("title"), "text",
        "sentiment_score", "sentiment_label", "bias_score", "biased_sentences",
        "propaganda_score", "propaganda_sentences", "final_score",
        F.date_format(when, C.HISTORY_DATE_FORMAT).alias("date"),
        given("email", C.DEFAULT_OWNER).alias("email"))


def analyse_from_tables(articles: DataFrame, sentences: DataFrame,
                        stars: DataFrame, propaganda: DataFrame,
                        bias_hits: DataFrame,
                        threshold: float = C.PROPAGANDA_THRESHOLD) -> DataFrame:
    """The same totals when scores come as tables, e.g. from another job.

    ``stars`` and ``propaganda`` hold ``article_id, sent_id, label, score``;
    ``bias_hits`` holds the sentences with a term. Each table is first summed
    per article (map side first), so only one row per article and task moves,
    and no sentence text does. Articles without a sentence drop out.
    """
    def per_article(rows: DataFrame, *measures) -> DataFrame:
        return rows.groupBy("article_id").agg(*measures)

    kept = is_propaganda(F.col("label"), F.col("score"), threshold)
    totals = (
        per_article(sentences, F.count("*").alias("total_sentences"))
        .join(per_article(stars, F.avg(S.star_value(F.col("label"))).alias("mean")),
              "article_id", "left")
        .join(per_article(bias_hits, F.count("*").alias("bias_score")),
              "article_id", "left")
        .join(per_article(propaganda, F.count_if(kept).alias("propaganda_score")),
              "article_id", "left"))
    filled = totals.select(
        "article_id", "total_sentences",
        S.round_cents(F.coalesce("mean", F.lit(float(C.NEUTRAL_STARS))))
        .alias("sentiment_score"),
        F.coalesce("bias_score", F.lit(0)).alias("bias_score"),
        F.coalesce("propaganda_score", F.lit(0)).alias("propaganda_score"))
    return articles.join(filled.withColumns({
        "sentiment_label": S.sentiment_class(F.col("sentiment_score")),
        "final_score": S.final_score(
            F.col("sentiment_score"), F.col("bias_score"),
            F.col("propaganda_score"), F.col("total_sentences")),
    }), "article_id")
