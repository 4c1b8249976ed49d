"""Techniques, entities, indicators, the source network and the summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.catalog.base import (
    GAZETTEER,
    TECHNIQUES,
    articles,
    detected_sql,
    query,
    table,
    tokens_sql,
)
from broadsheet.functions import fields as N
from broadsheet.functions import text as X
from broadsheet.operators import entities as E
from broadsheet.operators import graph
from broadsheet.operators.techniques import detect_techniques, flag_propaganda


@query("detect_techniques", f"""SELECT doc_id AS article_id,
  array_to_string({detected_sql()}, ', ') AS techniques FROM documents""")
def detect(spark, sf):
    found = detect_techniques(articles(spark, sf), TECHNIQUES)
    return found.select("article_id",
                        N.list_text(F.col("detected_techniques")).alias("techniques"))


@query("technique_flag", f"""SELECT doc_id AS article_id, len({detected_sql()}) > 0
  AS is_propaganda FROM documents""")
def technique_flag(spark, sf):
    found = detect_techniques(articles(spark, sf), TECHNIQUES)
    return flag_propaganda(found).select("article_id", "is_propaganda")


# --- Entities -------------------------------------------------------------------

GAZETTEER_VALUES = "(VALUES " + ", ".join(
    f"('{name}', '{label}')" for name, label in GAZETTEER.items()) + ")"

RUNS_SQL = f"""
toks AS (SELECT doc_id AS article_id, {tokens_sql('text')} AS toks FROM documents),
words AS (SELECT article_id, unnest(toks) AS w, unnest(range(len(toks))) AS pos FROM toks),
pairs AS (SELECT article_id, pos, w, w || ' ' || lead(w) OVER
  (PARTITION BY article_id ORDER BY pos) AS two FROM words),
runs AS (SELECT article_id, pos, w AS text FROM pairs
  UNION ALL SELECT article_id, pos, two FROM pairs),
found AS (SELECT article_id, CAST(pos AS INTEGER) AS pos, text, label FROM runs
  JOIN {GAZETTEER_VALUES} g(name, label) ON g.name = text)"""


@query("entities_gazetteer", f"WITH {RUNS_SQL} SELECT * FROM found")
def entities_gazetteer(spark, sf):
    names = spark.createDataFrame(list(GAZETTEER.items()), "name string, label string")
    return E.gazetteer_entities(articles(spark, sf), names, longest=2)


@query("entities_long_gazetteer", f"""
WITH b AS (SELECT conv_id, {tokens_sql('text')} AS w FROM conversations),
g AS (SELECT DISTINCT array_to_string(w[i:i + 1], ' ') AS name, 'PAIR' AS label
      FROM (SELECT w, unnest(range(1, len(w))) AS i FROM b)
      UNION SELECT w, 'WORD' FROM (SELECT unnest(w) AS w FROM b) WHERE length(w) > 7),
t AS (SELECT doc_id AS article_id, {tokens_sql('text')} AS w FROM documents),
p AS (SELECT article_id, CAST(i - 1 AS INTEGER) AS pos, w[i] AS one, w[i] || ' ' || w[i + 1] AS two
      FROM (SELECT article_id, w, unnest(range(1, len(w) + 1)) AS i FROM t))
SELECT article_id, pos, name AS text, label FROM p JOIN g ON g.name = p.one
UNION ALL SELECT article_id, pos, name, label FROM p JOIN g ON g.name = p.two""")
def entities_long_gazetteer(spark, sf):
    """Names by the ten thousand: pairs of words and long words of the conversations."""
    words = table(spark, sf, "conversations", "text").select(
        X.tokens_of(F.col("text")).alias("w"))
    pairs = words.select(F.explode(X.word_groups(F.col("w"), 2)).alias("r")).where("r.n = 2")
    long = words.select(F.explode("w").alias("name")).where("length(name) > 7")
    names = pairs.select(F.col("r.text").alias("name"), F.lit("PAIR").alias("label")).union(
        long.select("name", F.lit("WORD")))
    return E.gazetteer_entities(articles(spark, sf), names, longest=2)


@query("entities_flat", f"""WITH {RUNS_SQL},
flat AS (SELECT article_id, string_agg(text || ' (' || label || ')', ', '
  ORDER BY pos, length(text)) AS t FROM found GROUP BY 1)
SELECT doc_id AS article_id, coalesce(t, '') AS entities
FROM documents LEFT JOIN flat ON doc_id = article_id""")
def entities_flat(spark, sf):
    found = E.inline_entities(articles(spark, sf), GAZETTEER)
    return found.select("article_id", N.entities_text(F.col("entities")).alias("entities"))


@query("entities_rules", "WITH f AS (" + " UNION ALL ".join(
    f"SELECT doc_id AS article_id, '{label}' AS label, "
    f"regexp_extract_all(text, '{pattern}') AS texts FROM documents"
    for label, pattern in E.RULES.items()) + """)
SELECT article_id, label, CAST(unnest(range(len(texts))) AS INTEGER) AS nth,
  unnest(texts) AS text FROM f""")
def entities_rules(spark, sf):
    return E.pattern_entities(articles(spark, sf))


@query("indicators_flat", """
SELECT doc_id AS article_id, array_to_string(list_filter([
    CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END,
    CASE toxic WHEN 1 THEN 'toxic' WHEN 0 THEN 'clean' END], lambda x: x IS NOT NULL), ', ')
  AS indicators
FROM documents LEFT JOIN labels USING (doc_id)""")
def indicators_flat(spark, sf):
    """The labels of a document as its indicator list; many have none."""
    marks = table(spark, sf, "labels").select(
        F.col("doc_id").alias("article_id"), F.array(
            F.when(F.col("quality") == 1, "good").otherwise("poor"),
            F.when(F.col("toxic") == 1, "toxic").otherwise("clean")).alias("indicators"))
    docs = table(spark, sf, "documents", "doc_id").withColumnRenamed("doc_id", "article_id")
    return docs.join(marks, "article_id", "left").select(
        "article_id", N.list_text(F.col("indicators")).alias("indicators"))


# --- Source network ---------------------------------------------------------------

PUBLISHED = ("SELECT coalesce(source, 'Unknown') AS source, CAST(doc_id AS VARCHAR) "
             "AS article_id FROM documents")


@query("source_nodes", f"""SELECT DISTINCT source AS id, 'source' AS type FROM ({PUBLISHED})
UNION ALL SELECT DISTINCT article_id, 'article' FROM ({PUBLISHED})""")
def source_nodes(spark, sf):
    return graph.source_nodes(table(spark, sf, "documents", "doc_id", "source")
                              .withColumnRenamed("doc_id", "article_id"))


@query("source_edges", f"""SELECT DISTINCT least(source, article_id) AS src,
  greatest(source, article_id) AS dst FROM ({PUBLISHED})""")
def source_edges(spark, sf):
    return graph.source_edges(table(spark, sf, "documents", "doc_id", "source")
                              .withColumnRenamed("doc_id", "article_id"))
