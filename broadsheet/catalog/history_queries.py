"""History scans, order, defaults, older shapes, and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.catalog.base import (
    TECHNIQUES,
    articles,
    query,
    rounded,
    sentences_sql,
    sql_array,
    table,
)
from broadsheet.functions import scores as S
from broadsheet.functions import text as X
from broadsheet.operators import history as H
from broadsheet.sources.history import unify_history

# Each event as a saved analysis: errors come from the older generation, which
# names the owner in "username"; views lack the label, signups the score.
SAVED = """SELECT event_id, event_type || ' report' AS title,
  CASE WHEN event_type <> 'signup' THEN (100 + event_id % 401) / 100.0::DOUBLE END
    AS sentiment_score,
  CASE WHEN event_type <> 'view' THEN CASE WHEN (100 + event_id % 401) / 100.0 >= 3.5
    THEN 'Positive' WHEN (100 + event_id % 401) / 100.0 <= 2.5 THEN 'Negative'
    ELSE 'Neutral' END END AS sentiment_label,
  CASE WHEN event_id % 7 > 0 THEN event_id % 7 END AS bias_score,
  event_id % 5 AS propaganda_score, least(100.0, value) AS final_score,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS date,
  'user' || user_id || '@example.com' AS email FROM events"""


def saved(spark, sf):
    events = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value")
    score = (F.col("event_id") % 401 + 100) / 100.0
    kind = F.col("event_type")
    owner = F.concat(F.lit("user"), F.col("user_id"), F.lit("@example.com"))
    rows = events.select(
        "event_id", F.concat(kind, F.lit(" report")).alias("title"),
        F.when(kind != "signup", score).alias("sentiment_score"),
        F.when(kind != "view", S.sentiment_class(score)).alias("sentiment_label"),
        F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 7).alias("bias_score"),
        (F.col("event_id") % 5).alias("propaganda_score"),
        F.least(F.lit(100.0), "value").alias("final_score"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"),
        F.when(kind != "error", owner).alias("email"),
        F.when(kind == "error", owner).alias("username"))
    return unify_history(rows)


@query("history_for_user", f"""SELECT event_id, title, date, final_score
FROM ({SAVED}) WHERE email = 'user8@example.com'""")
def history_for_user(spark, sf):
    return H.history_of(saved(spark, sf), "user8@example.com").select(
        "event_id", "title", "date", "final_score")


@query("history_sorted", f"""SELECT event_id, email, date,
  strptime(date, '%Y-%m-%d %H:%M:%S') AS recorded_at,
  row_number() OVER (PARTITION BY email ORDER BY date DESC, event_id) AS recency
FROM ({SAVED})""")
def history_sorted(spark, sf):
    rows = saved(spark, sf).select("event_id", "email", "date")
    return H.rank_by_date(rows, "event_id").select(
        "event_id", "email", "date", "recorded_at", "recency")


# Titles with a sign that no file may have, in two spellings, and shared by many records.
EXPORTED = """SELECT event_id, date, 'analysis_' ||
  replace(CASE WHEN event_id % 2 = 0 THEN upper(title) ELSE title END, ' ', '_') || '_'
  || user_id % 50 AS name FROM (SELECT s.*, user_id FROM ({saved}) s JOIN events USING (event_id))"""


@query("export_files", f"""WITH n AS ({EXPORTED.format(saved=SAVED)}),
r AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY date, event_id) AS nth FROM n)
SELECT event_id, name || CASE WHEN nth = 1 THEN '' ELSE ' (' || nth || ')' END || '.csv'
  AS file_name FROM r""")
def export_files(spark, sf):
    """The export file of every record; few titles, so most names are numbered."""
    owner = F.regexp_extract("email", r"(\d+)", 1).cast("long")
    title = F.concat(F.when(F.col("event_id") % 2 == 0, F.upper("title"))
                     .otherwise(F.col("title")), F.lit("/"), owner % 50)
    rows = saved(spark, sf).select("event_id", "date", title.alias("title"))
    return H.export_file_names(rows, "event_id").select("event_id", "file_name")


@query("history_newest_first", f"""SELECT event_id, email, date FROM ({SAVED})
ORDER BY date DESC, event_id""")
def history_newest_first(spark, sf):
    return H.newest_first(saved(spark, sf).select("event_id", "email", "date"), "event_id")


@query("history_defaults", f"""SELECT event_id, title, date, email,
  coalesce(sentiment_label, 'Neutral') AS sentiment_label,
  coalesce(sentiment_score, 3.0) AS sentiment_score, coalesce(bias_score, 0) AS bias_score,
  propaganda_score, final_score, printf('%.2f', coalesce(sentiment_score, 3.0)) AS sentiment_text,
  printf('%.2f', final_score) AS final_text,
  CASE coalesce(sentiment_label, 'Neutral') WHEN 'Positive' THEN '#28a745'
    WHEN 'Negative' THEN '#dc3545' ELSE '#6c757d' END AS sentiment_color
FROM ({SAVED})""")
def history_defaults(spark, sf):
    return H.display_scores(H.with_display_defaults(saved(spark, sf))).select(
        "event_id", "title", "date", "email", "sentiment_label", "sentiment_score",
        "bias_score", "propaganda_score", "final_score", "sentiment_text", "final_text",
        "sentiment_color")


@query("history_union", f"""SELECT event_id, email, date, sentiment_score, bias_score
FROM ({SAVED}) WHERE title <> 'purchase report' UNION ALL
SELECT event_id, email, date, sentiment_score, NULL FROM ({SAVED})
WHERE title = 'purchase report'""")
def history_union(spark, sf):
    rows = saved(spark, sf).select(
        "event_id", "title", "email", "date", "sentiment_score", "bias_score")
    bought = F.col("title") == "purchase report"
    return H.union_histories(rows.filter(~bought),
                             rows.filter(bought).drop("bias_score")).drop("title")


@query("history_technique_unnest", f"""
WITH sents AS ({sentences_sql()}),
n AS (SELECT article_id, sent_id, sentence, unnest(list_filter({sql_array(TECHNIQUES)},
  lambda t: contains(lower(sentence), lower(t)))) AS technique FROM sents)
SELECT article_id, sent_id AS pos, technique, round(1.0 / length(technique), 6) AS score FROM n""")
def history_technique_unnest(spark, sf):
    """Articles as older records: a technique and a score list per sentence."""
    names = F.array(*map(F.lit, TECHNIQUES))

    def record(sentence):
        found = F.filter(names, lambda n: F.contains(F.lower(sentence), F.lower(n)))
        return F.struct(sentence.alias("sentence"), found.alias("detected_techniques"),
                        F.transform(found, lambda n: 1.0 / F.length(n)).alias("scores"))

    rows = articles(spark, sf).select(
        "article_id", X.sentences_of(F.col("content")).alias("sentences"))
    old = rows.select("article_id", F.transform("sentences", record)
                      .alias("propaganda_sentences"))
    return H.technique_rows(old, "article_id").select(
        "article_id", "pos", "technique", rounded("score"))


@query("feedback_valid", """
SELECT conv_id, turn, coalesce(CASE WHEN role <> 'system' THEN role || '@example.com' END,
  'guest') AS email, TIMESTAMP '2024-10-17 00:00:00' + to_minutes(conv_id) AS timestamp,
  text AS feedback FROM conversations
WHERE CASE WHEN turn % 3 = 0 THEN '  ' ELSE text END <> '  '""")
def feedback_valid(spark, sf):
    """Turns as feedback; every third one was sent blank."""
    turns = table(spark, sf, "conversations")
    entries = turns.select(
        "conv_id", "turn",
        F.when(F.col("role") != "system",
               F.concat("role", F.lit("@example.com"))).alias("email"),
        F.timestamp_seconds(F.unix_timestamp(F.lit("2024-10-17 00:00:00").cast("timestamp"))
                            + 60 * F.col("conv_id")).alias("timestamp"),
        F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.col("text")).alias("feedback"))
    return H.valid_feedback(entries)
