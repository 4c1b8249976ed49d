"""Normalised tokens, term statistics, TF-IDF, labels, metrics, topics by class."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from broadsheet import constants as C
from broadsheet.catalog.base import (
    GAZETTEER,
    TECHNIQUES,
    articles,
    detected_sql,
    query,
    rounded,
    sql_array,
    sql_values,
    table,
    tokens_sql,
    whole_sql,
)
from broadsheet.catalog.corpus_queries import RUNS_SQL
from broadsheet.functions import fields as N
from broadsheet.functions import text as X
from broadsheet.operators import features as O
from broadsheet.operators import lemmas as M
from broadsheet.operators import metrics, summary, topics
from broadsheet.operators.techniques import (
    detect_techniques,
    detect_whole_techniques,
    flag_propaganda,
)
from broadsheet.operators.unnest import unnest
from broadsheet.plans.annotate import annotate_text

CLASSES = sorted(n for n in TECHNIQUES if n not in ("Repetitive Phrasing", "Loaded Language"))


def normalized_sql(column: str) -> str:
    """List of normalised tokens."""
    stops = sql_values(sorted(C.STOP_WORDS))
    return rf"""list_transform(list_filter({tokens_sql(column)}, lambda t: t NOT IN ({stops})),
  lambda t: CASE WHEN length(t) <= 3 THEN t
    WHEN regexp_matches(t, 'sses$') THEN regexp_replace(t, 'sses$', 'ss')
    WHEN regexp_matches(t, 'ies$') THEN regexp_replace(t, 'ies$', 'y')
    WHEN regexp_matches(t, '(ss|us|is)$') THEN t
    WHEN regexp_matches(t, 's$') THEN regexp_replace(t, 's$', '') ELSE t END)"""


@query("normalize_tokens", f"""SELECT doc_id AS article_id,
  array_to_string({normalized_sql('text')}, ' ') AS processed_content FROM documents""")
def normalize_tokens(spark, sf):
    return O.with_normalized_tokens(articles(spark, sf), O.stop_words()).select(
        "article_id", "processed_content")


FREQUENCIES_SQL = f"""
w AS (SELECT doc_id AS article_id, unnest(list_filter({tokens_sql('text')},
        lambda t: length(t) >= 2)) AS term FROM documents),
tf AS (SELECT article_id, term, count(*) AS tf FROM w GROUP BY 1, 2),
df AS (SELECT term, CAST(sum(tf) AS BIGINT) AS term_frequency,
         count(*) AS document_frequency FROM tf GROUP BY 1)"""


@query("term_stats", f"WITH {FREQUENCIES_SQL} SELECT * FROM df")
def term_stats(spark, sf):
    return O.term_stats(articles(spark, sf), O.feature_terms("content"))


# --- Lemmas learnt from the corpus -------------------------------------------------

SINGLE_SQL = """CASE WHEN length(term) <= 3 THEN term
  WHEN regexp_matches(term, 'sses$') THEN regexp_replace(term, 'sses$', 'ss')
  WHEN regexp_matches(term, 'ies$') THEN regexp_replace(term, 'ies$', 'y')
  WHEN regexp_matches(term, '(ss|us|is)$') THEN term
  WHEN regexp_matches(term, 's$') THEN regexp_replace(term, 's$', '') ELSE term END"""
LEMMAS_SQL = f"""{FREQUENCIES_SQL},
single AS (SELECT term, {SINGLE_SQL} AS single FROM df),
dict AS (SELECT s.term, coalesce(d.term, s.term) AS lemma,
  substr(md5(s.term), 1, 2) < '33' AS held_out
  FROM single s LEFT JOIN df d ON d.term = s.single)"""
RULES_SQL = f"""{LEMMAS_SQL},
votes AS (SELECT right(term, k) AS ending, CASE WHEN starts_with(lemma, left(term, length(term) - k))
    THEN substr(lemma, length(term) - k + 1) END AS replacement, count(*) AS n
  FROM dict, (SELECT CAST(unnest(range({M.LONGEST + 1})) AS INTEGER) AS k)
  WHERE NOT held_out AND k <= length(term) GROUP BY 1, 2),
best AS (SELECT ending, replacement, n AS support,
  row_number() OVER (PARTITION BY ending ORDER BY replacement IS NULL, n DESC, replacement) AS rank,
  CAST(sum(n) OVER (PARTITION BY ending) AS BIGINT) AS words FROM votes),
rules AS (SELECT ending, replacement, support, words FROM best
  WHERE rank = 1 AND replacement IS NOT NULL AND support >= {M.LEAST}
  AND support * {M.MOST} >= (SELECT count(*) FROM dict WHERE NOT held_out)
  AND support * 100 >= words * {M.PERCENT})"""
# Of every term of the corpus: the lemma of the longest ending with a rule.
RULED_SQL = f"""{RULES_SQL},
ruled AS (SELECT d.term, any_value(d.lemma) AS known, any_value(held_out) AS held_out,
  coalesce(arg_max(left(d.term, length(d.term) - length(ending)) || replacement, length(ending)),
           d.term) AS lemma
  FROM dict d LEFT JOIN rules ON ends_with(d.term, ending) GROUP BY d.term)"""


def corpus_lemmas(spark, sf):
    """Lemmas of all terms of the corpus; a fifth of the terms is held out."""
    lemmas = M.corpus_lemmas(O.term_stats(articles(spark, sf), O.feature_terms("content")))
    return lemmas.withColumn("held_out", O.is_test_row(F.col("term")))


def learnt_rules(spark, sf):
    return M.LemmaRules.learn(corpus_lemmas(spark, sf).where("NOT held_out"))


@query("corpus_lemmas", f"WITH {LEMMAS_SQL} SELECT * FROM dict")
def lemma_dictionary(spark, sf):
    return corpus_lemmas(spark, sf)


@query("lemma_rules", f"WITH {RULES_SQL} SELECT * FROM rules")
def lemma_rules(spark, sf):
    return M.ending_rules(corpus_lemmas(spark, sf).where("NOT held_out"))


@query("lemmas_by_rule", f"""WITH {RULED_SQL}
SELECT held_out, count(*) AS terms, count(*) FILTER (lemma = known) AS right_lemmas,
  count(*) FILTER (lemma <> term) AS changed FROM ruled GROUP BY held_out""")
def lemmas_by_rule(spark, sf):
    """How often the rules alone give the table's lemma, on seen and held-out terms."""
    ruled = corpus_lemmas(spark, sf).withColumn(
        "ruled", F.expr(learnt_rules(spark, sf).sql("term")))
    return ruled.groupBy("held_out").agg(
        F.count("*").alias("terms"), F.count_if(F.expr("ruled = lemma")).alias("right_lemmas"),
        F.count_if(F.expr("ruled <> term")).alias("changed"))


@query("lemmatized_terms", f"""WITH {RULED_SQL}
SELECT term, CASE WHEN held_out THEN lemma ELSE known END AS lemma FROM ruled""")
def lemmatized_terms(spark, sf):
    """Every term by the table of seen terms, else by the rules learnt from it."""
    lemmas = corpus_lemmas(spark, sf)
    seen = lemmas.where("NOT held_out")
    return M.lemmatized(lemmas.select("term"), seen, learnt_rules(spark, sf))


@query("normalize_tokens_learnt", f"""WITH {RULED_SQL},
kept AS (SELECT doc_id AS article_id, list_filter({tokens_sql('text')},
    lambda t: t NOT IN ({sql_values(sorted(C.STOP_WORDS))})) AS toks FROM documents),
tall AS (SELECT article_id, unnest(toks) AS term, unnest(range(len(toks))) AS pos FROM kept),
-- Tokens of one letter are in no vocabulary; the rules hold for them too.
short AS (SELECT t.term, coalesce(arg_max(left(t.term, length(t.term) - length(ending))
    || replacement, length(ending)), t.term) AS lemma
  FROM (SELECT DISTINCT term FROM tall WHERE length(term) < 2) t
  LEFT JOIN rules ON ends_with(t.term, ending) GROUP BY t.term),
lemmas AS (SELECT term, lemma FROM ruled UNION ALL SELECT * FROM short),
joined AS (SELECT article_id, string_agg(lemma, ' ' ORDER BY pos) AS processed_content
  FROM tall JOIN lemmas USING (term) GROUP BY 1)
SELECT article_id, coalesce(processed_content, '') AS processed_content
  FROM kept LEFT JOIN joined USING (article_id)""")
def normalize_tokens_learnt(spark, sf):
    """Normalised texts with lemmas by the learnt rules, inside the row."""
    return O.with_normalized_tokens(
        articles(spark, sf), O.stop_words(), lemma=learnt_rules(spark, sf).sql).select(
            "article_id", "processed_content")


@query("tfidf", f"""WITH {FREQUENCIES_SQL},
vocab AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + document_frequency)) + 1
  AS idf FROM df ORDER BY term_frequency DESC, term LIMIT 5000),
raw AS (SELECT article_id, term, tf * idf AS raw FROM tf JOIN vocab USING (term))
SELECT article_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY article_id)), 6)
  AS weight FROM raw""")
def tfidf(spark, sf):
    return O.tfidf(articles(spark, sf), O.feature_terms("content")).select(
        "article_id", "term", rounded("weight"))


@query("split_train_test", """SELECT doc_id AS article_id,
  substr(md5(CAST(doc_id AS VARCHAR)), 1, 2) < '33' AS is_test FROM documents""")
def split_train_test(spark, sf):
    return table(spark, sf, "documents", "doc_id").select(
        F.col("doc_id").alias("article_id"), O.is_test_row(F.col("doc_id")).alias("is_test"))


# --- Labels and metrics -----------------------------------------------------------

def judged(spark, sf):
    """Names found anywhere as truth, names standing alone as prediction."""
    both = detect_whole_techniques(
        detect_techniques(articles(spark, sf), TECHNIQUES, output="truth"),
        TECHNIQUES, output="pred")
    return both.select("article_id", "truth", "pred")


JUDGED = f"""j AS (SELECT doc_id AS article_id, {detected_sql()} AS truth,
  {whole_sql()} AS pred FROM documents)"""


@query("label_vocab", f"""SELECT DISTINCT unnest({detected_sql()}) AS label FROM documents""")
def label_vocab(spark, sf):
    return O.label_vocabulary(judged(spark, sf), "truth")


@query("label_matrix", f"""SELECT doc_id AS article_id,
  array_to_string(list_transform({sql_array(CLASSES)},
    lambda c: CASE WHEN list_contains({detected_sql()}, c) THEN 1 ELSE 0 END), ',') AS flags,
  array_to_string(list_sort({detected_sql()}), ', ') AS labels FROM documents""")
def label_matrix(spark, sf):
    rows = judged(spark, sf)
    classes = CLASSES
    wide = rows.select("article_id", O.binarize(F.col("truth"), classes).alias("flags"))
    return wide.select(
        "article_id", F.array_join(F.col("flags").cast("array<string>"), ",").alias("flags"),
        N.list_text(O.labels_of(F.col("flags"), classes)).alias("labels"))


WRONG = ("(len(list_filter(truth, lambda t: NOT list_contains(pred, t))) + "
         "len(list_filter(pred, lambda t: NOT list_contains(truth, t))))")


@query("multilabel_metrics", f"""WITH {JUDGED}
SELECT round(avg(CASE WHEN {WRONG} = 0 THEN 1.0 ELSE 0.0 END), 6) AS subset_accuracy,
  round(sum({WRONG}) / (count(*) * {len(CLASSES)}), 6) AS hamming_loss FROM j""")
def multilabel_metrics(spark, sf):
    return metrics.multilabel_metrics(judged(spark, sf), len(CLASSES)).select(
        rounded("subset_accuracy"), rounded("hamming_loss"))


FIGURES = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
  tp + fn AS support"""


@query("classification_report", f"""WITH {JUDGED},
c AS (SELECT unnest({sql_array(CLASSES)}) AS label),
k AS (SELECT label,
  count(*) FILTER (list_contains(truth, label) AND list_contains(pred, label)) AS tp,
  count(*) FILTER (NOT list_contains(truth, label) AND list_contains(pred, label)) AS fp,
  count(*) FILTER (list_contains(truth, label) AND NOT list_contains(pred, label)) AS fn
  FROM c, j GROUP BY label),
per AS (SELECT label, {FIGURES} FROM k),
micro AS (SELECT 'micro avg' AS label, {FIGURES} FROM
  (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM k)),
macro AS (SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per),
weighted AS (SELECT 'weighted avg', sum(precision * support) / sum(support),
  sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM per),
each AS (SELECT len(list_intersect(truth, pred)) AS tp, len(truth) AS t, len(pred) AS p FROM j),
samples AS (SELECT 'samples avg', avg(CASE WHEN p > 0 THEN tp / p ELSE 0 END),
  avg(CASE WHEN t > 0 THEN tp / t ELSE 0 END),
  avg(CASE WHEN tp > 0 THEN 2 * tp / (t + p) ELSE 0 END), sum(t) FROM each),
u AS (SELECT * FROM per UNION ALL SELECT * FROM micro UNION ALL SELECT * FROM macro
  UNION ALL SELECT * FROM weighted UNION ALL SELECT * FROM samples)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM u""")
def classification_report(spark, sf):
    report = metrics.classification_report(judged(spark, sf), CLASSES)
    return report.select("label", rounded("precision"), rounded("recall"), rounded("f1"),
                         "support")


# --- Topics over a given class --------------------------------------------------

def by_language(spark, sf):
    """Articles with the rank of their language, by size, as topic number.

    The ranks are sent to the articles: by shuffle, a language's articles would meet in
    one task.
    """
    docs = O.with_normalized_tokens(articles(spark, sf, "lang"), O.stop_words())
    sizes = table(spark, sf, "documents", "lang").groupBy("lang").agg(F.count("*").alias("n"))
    # One row per language.
    order = Window.orderBy(F.desc("n"), "lang")
    ranks = sizes.select("lang", (F.row_number().over(order) - 1).alias("topic"))
    return docs.join(F.broadcast(ranks), "lang")


LANGUAGES = f"""
langs AS (SELECT lang, CAST(row_number() OVER (ORDER BY count(*) DESC, lang) - 1 AS INTEGER)
  AS topic FROM documents GROUP BY lang),
docs AS (SELECT doc_id, topic, {normalized_sql('text')} AS tokens
  FROM documents JOIN langs USING (lang)),
ct AS (SELECT topic, term, count(*) AS tf FROM
  (SELECT topic, unnest(tokens) AS term FROM docs) GROUP BY 1, 2),
ft AS (SELECT term, sum(tf) AS f FROM ct GROUP BY 1),
scored AS (SELECT topic, term, tf,
  tf * ln(1 + (SELECT sum(tf) / count(DISTINCT topic) FROM ct) / f) AS score
  FROM ct JOIN ft USING (term)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS rank
  FROM scored),
named AS (SELECT topic, topic || '_' || string_agg(term, '_' ORDER BY rank) AS name
  FROM ranked WHERE rank <= 4 GROUP BY 1),
info AS (SELECT topic, count(*) AS count, any_value(name) AS name
  FROM docs JOIN named USING (topic) GROUP BY 1)"""


@query("ctfidf", f"""WITH {LANGUAGES}
SELECT topic, term, tf, round(score, 6) AS score FROM scored""")
def ctfidf(spark, sf):
    words = unnest(by_language(spark, sf), "tokens", "topic", value="term")
    return topics.class_tfidf(words).select("topic", "term", "tf", rounded("score"))


def _info(docs):
    return topics.topic_overview(topics.topic_counts(docs))


@query("topic_info", f"WITH {LANGUAGES} SELECT * FROM info")
def topic_info(spark, sf):
    return _info(by_language(spark, sf))


@query("report_summary", f"""WITH {LANGUAGES},
f AS (SELECT len({detected_sql()}) > 0 AS flag FROM documents)
SELECT count(*) FILTER (flag) AS propaganda_articles,
  count(*) FILTER (NOT flag) AS other_articles,
  (SELECT string_agg('Topic ' || topic || ': ' || name, '<br>' ORDER BY topic) FROM info)
    AS topics_html FROM f""")
def report_summary(spark, sf):
    docs = by_language(spark, sf)
    flagged = flag_propaganda(detect_techniques(docs, TECHNIQUES))
    return summary.report_summary(flagged, _info(docs))


@query("annotated_text", f"""WITH {RUNS_SQL},
flat AS (SELECT article_id, string_agg(text || ' (' || label || ')', ', '
  ORDER BY pos, length(text)) AS t FROM found GROUP BY 1)
SELECT doc_id AS article_id, array_to_string({normalized_sql('d.text')}, ' ') AS processed_content,
  array_to_string({detected_sql('d.text')}, ', ') AS techniques,
  len({detected_sql('d.text')}) > 0 AS is_propaganda, coalesce(t, '') AS entities
FROM documents d LEFT JOIN flat ON doc_id = article_id""")
def annotated_text(spark, sf):
    done = annotate_text(articles(spark, sf), techniques=TECHNIQUES, gazetteer=GAZETTEER,
                         stop_words=O.stop_words())
    return done.select("article_id", "processed_content",
                       N.list_text(F.col("techniques")).alias("techniques"), "is_propaganda",
                       N.entities_text(F.col("entities")).alias("entities"))
