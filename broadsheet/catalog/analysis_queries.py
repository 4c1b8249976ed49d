"""The article analysis, its parts, comparison and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet import constants as C
from broadsheet.catalog.base import (
    FOLDED,
    NEGATIVE,
    POSITIVE,
    SCORING,
    STARS,
    TERMS,
    articles,
    hits_sql,
    query,
    rounded,
    table,
    totals_sql,
)
from broadsheet.functions import fields as N
from broadsheet.functions.predicates import is_propaganda
from broadsheet.functions.scores import star_value
from broadsheet.operators import history as H
from broadsheet.operators import lexicon as L
from broadsheet.operators.scorers import ModelScorer, sentence_scores, word_model
from broadsheet.operators.sentences import sentence_table
from broadsheet.plans import compare
from broadsheet.plans.article_analysis import analysis_records, score_articles

FIGURES = ("article_id", "total_sentences", "sentiment_score", "sentiment_label",
           "bias_score", "propaganda_score")

ANALYSIS_COLUMNS = """article_id, CAST(n AS INTEGER) AS total_sentences, sentiment_score,
  sentiment_label, bias_score, propaganda_score, round(final_score, 6) AS final_score,
  biased_detail"""


def _analysis(rows, fold):
    scored = score_articles(rows, fold=fold, **SCORING)
    return scored.select(*FIGURES, rounded("final_score"),
                         N.biased_text(F.col("biased_sentences")).alias("biased_detail"))


@query("article_analysis",
       f"WITH {hits_sql()}, {totals_sql()} SELECT {ANALYSIS_COLUMNS} FROM totals")
def article_analysis(spark, sf):
    return _analysis(articles(spark, sf), fold=False)


@query("article_analysis_folded",
       f"WITH {hits_sql(FOLDED)}, {totals_sql()} SELECT {ANALYSIS_COLUMNS} FROM totals")
def article_analysis_folded(spark, sf):
    return _analysis(articles(spark, sf), fold=True)


@query("article_sentiment", f"""WITH {hits_sql(FOLDED)}, {totals_sql()}
SELECT article_id, sentiment_score, sentiment_label FROM totals""")
def article_sentiment(spark, sf):
    return score_articles(articles(spark, sf), **SCORING).select(
        "article_id", "sentiment_score", "sentiment_label")


@query("bias_counts", f"""WITH {hits_sql()}
SELECT d.doc_id AS article_id, coalesce(n, 0) AS bias_score FROM documents d LEFT JOIN
  (SELECT article_id, count(*) AS n FROM hits WHERE len(terms) > 0 GROUP BY 1) h
  ON d.doc_id = h.article_id""")
def bias_counts(spark, sf):
    return L.bias_counts(articles(spark, sf), C.DEFAULT_BIAS_TERMS)


@query("propaganda_counts", f"""WITH {hits_sql(FOLDED)}, {totals_sql()}
SELECT article_id, propaganda_score FROM totals""")
def propaganda_counts(spark, sf):
    return score_articles(articles(spark, sf), **SCORING).select(
        "article_id", "propaganda_score")


STARS_SQL = f"""WITH {hits_sql()}
SELECT article_id, sent_id, CASE stars WHEN 1 THEN '1 star' ELSE stars || ' stars' END AS label,
  CAST(stars AS INTEGER) AS stars FROM hits"""


@query("sentence_stars", STARS_SQL)
def sentence_stars(spark, sf):
    scored = sentence_scores(sentence_table(articles(spark, sf)), STARS)
    return scored.select("article_id", "sent_id", "label",
                         star_value(F.col("label")).alias("stars"))


@query("sentence_stars_udf", STARS_SQL)
def sentence_stars_udf(spark, sf):
    model = ModelScorer(word_model(POSITIVE, NEGATIVE), batch_size=C.STAR_BATCH)
    scored = sentence_scores(sentence_table(articles(spark, sf)), model)
    return scored.select("article_id", "sent_id", "label",
                         star_value(F.col("label")).alias("stars"))


@query("propaganda_sentences", f"""WITH {hits_sql()}
SELECT article_id, sent_id, sentence, 'Propaganda' AS label, round(h / (h + 0.1), 6) AS score
FROM hits WHERE h / (h + 0.1) >= 0.9""")
def propaganda_sentences(spark, sf):
    scored = sentence_scores(sentence_table(articles(spark, sf)), TERMS)
    kept = scored.filter(is_propaganda(F.col("label"), F.col("score")))
    return kept.select("article_id", "sent_id", "sentence", "label", rounded("score"))


TURNS = r"""SELECT conv_id AS batch_id, turn AS article_id,
  regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g') AS content
  FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations
    GROUP BY 1 HAVING count(*) >= 2)"""


@query("compare_articles", f"""
WITH {hits_sql(TURNS, 'batch_id')}, {totals_sql('batch_id, article_id')}
SELECT batch_id, article_id, role || ' ' || article_id AS title, sentiment_score,
  sentiment_label, bias_score AS bias_count, propaganda_score AS propaganda_count,
  round(final_score, 6) AS final_score,
  CASE sentiment_label WHEN 'Positive' THEN '#28a745' WHEN 'Negative' THEN '#dc3545'
    ELSE '#6c757d' END AS sentiment_color,
  sentiment_score = max(sentiment_score) OVER w AS is_max_sentiment_score,
  bias_score = max(bias_score) OVER w AS is_max_bias_count,
  propaganda_score = max(propaganda_score) OVER w AS is_max_propaganda_count,
  final_score = max(final_score) OVER w AS is_max_final_score
FROM totals JOIN conversations c ON c.conv_id = batch_id AND c.turn = article_id
WINDOW w AS (PARTITION BY batch_id)""")
def compare_articles(spark, sf):
    """The turns of a conversation are the articles of one comparison."""
    turns = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("batch_id"), F.col("turn").alias("article_id"),
        F.concat_ws(" ", "role", "turn").alias("title"), F.col("text").alias("content"))
    scored = score_articles(compare.comparable(turns), **SCORING)
    shown = compare.mark_highest(
        compare.comparison_table(scored, "batch_id", "article_id"))
    return shown.withColumn("final_score", F.round("final_score", 6))


@query("export_rows", f"""WITH {hits_sql(FOLDED)}, {totals_sql()},
j AS (SELECT article_id,
  coalesce('[' || string_agg(to_json({{'sentence': sentence, 'detected_terms': terms}})::VARCHAR,
    ',' ORDER BY sent_id) FILTER (len(terms) > 0) || ']', '[]') AS biased,
  coalesce('[' || string_agg(to_json({{'sentence': sentence, 'score': h / (h + 0.1),
    'label': 'Propaganda'}})::VARCHAR, ',' ORDER BY sent_id)
    FILTER (h / (h + 0.1) >= 0.9) || ']', '[]') AS flagged FROM hits GROUP BY 1)
SELECT article_id, 'doc ' || article_id AS title, '2024-10-17 08:30:00' AS analyzed,
  'guest' AS analyzed_by, sentiment_score, sentiment_label, bias_score AS bias_count,
  propaganda_score AS propaganda_count, round(final_score, 6) AS final_score,
  printf('%.2f', sentiment_score) AS sentiment_text, printf('%.2f', final_score) AS final_text,
  biased AS biased_sentences, flagged AS propaganda_sentences,
  'analysis_doc_' || article_id || '.csv' AS file_name
FROM totals JOIN j USING (article_id)""")
def export_rows(spark, sf):
    docs = articles(spark, sf).withColumn("title", F.concat_ws(" ", F.lit("doc"), "article_id"))
    records = analysis_records(
        score_articles(docs, **SCORING), F.lit("2024-10-17 08:30:00").cast("timestamp"),
        "article_id")
    shown = H.display_scores(records)
    rows = H.export_rows(shown, "article_id", "sentiment_text", "final_text")
    names = {"Title": "title", "Date": "analyzed", "Analyzed By": "analyzed_by",
             "Sentiment Score": "sentiment_score", "Sentiment Label": "sentiment_label",
             "Bias Count": "bias_count", "Propaganda Count": "propaganda_count",
             "Final Score": "final_score", "Biased Sentences": "biased_sentences",
             "Propaganda Sentences": "propaganda_sentences"}
    return rows.withColumnsRenamed(names).withColumn(
        "final_score", F.round("final_score", 6))
