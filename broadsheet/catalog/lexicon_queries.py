"""Lexicon scans, matches and maintenance; technique lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet import constants as C
from broadsheet.catalog.base import (
    BLANKS,
    articles,
    query,
    sentences_sql,
    sql_array,
    table,
    tokens_sql,
)
from broadsheet.functions import fields as N
from broadsheet.functions import text as X
from broadsheet.operators import lexicon as L
from broadsheet.operators.techniques import (
    detect_listed_techniques,
    detect_substring_techniques,
)
from broadsheet.operators.sentences import sentence_table
from broadsheet.sinks.lexicon_store import changes_of, fold_changes
from broadsheet.sources import lexicons, techniques

DEFAULTS_SQL = "(VALUES " + ", ".join(
    f"({i}, '{term}')" for i, term in enumerate(C.DEFAULT_BIAS_TERMS)) + ")"

@query("lexicon_default", f"""
WITH used AS (SELECT term, count(*) AS articles FROM (
  SELECT unnest(list_distinct({tokens_sql('text')})) AS term FROM documents) GROUP BY 1)
SELECT CAST(pos AS INTEGER) AS pos, l.term, coalesce(articles, 0) AS articles
FROM {DEFAULTS_SQL} l(pos, term) LEFT JOIN used USING (term)""")
def lexicon_default(spark, sf):
    return L.term_usage(articles(spark, sf), lexicons.built_in_lexicon(spark)).select(
        "pos", "term", "articles")

@query("src_user_lexicon", f"""
WITH t AS (SELECT conv_id || '-' || turn AS owner, {tokens_sql('text')} AS terms
           FROM conversations)
SELECT owner, CAST(unnest(range(len(terms))) AS INTEGER) AS pos, unnest(terms) AS term FROM t""")
def src_user_lexicon(spark, sf):
    turns = table(spark, sf, "conversations", "conv_id", "turn", "text")
    lists = turns.select(F.concat_ws("-", "conv_id", "turn").alias("username"),
                         X.tokens_of(F.col("text")).alias("bias_terms"))
    return lexicons.explode_terms(lists, "username", "bias_terms")

@query("src_techniques", """
WITH t AS (SELECT conv_id, turn, string_split(text, chr(10)) AS names FROM conversations)
SELECT conv_id, turn, CAST(unnest(range(len(names))) AS INTEGER) AS pos,
  unnest(names) AS technique FROM t""")
def src_techniques(spark, sf):
    """Each turn as a JSON array of lines, read as a technique list."""
    turns = table(spark, sf, "conversations", "conv_id", "turn", "text")
    lists = turns.select("conv_id", "turn", F.to_json(F.split("text", "\n")).alias("json"))
    return techniques.parse_techniques(lists, "json", "conv_id", "turn")

MATCH_SQL = f"""
WITH sents AS ({sentences_sql()}),
m AS (SELECT article_id, sent_id, list_sort(list_intersect({tokens_sql('sentence')},
  {sql_array(C.DEFAULT_BIAS_TERMS)})) AS terms FROM sents)
SELECT article_id, sent_id, array_to_string(terms, ', ') AS terms FROM m WHERE len(terms) > 0"""

@query("biased_sentences", MATCH_SQL)
def biased_sentences(spark, sf):
    """Lexicon as a table."""
    found = L.match_lexicon(sentence_table(articles(spark, sf)),
                            lexicons.built_in_lexicon(spark))
    return found.select("article_id", "sent_id",
                        N.terms_text(F.col("detected_terms")).alias("terms"))

@query("bias_terms_array", MATCH_SQL)
def bias_terms_array(spark, sf):
    """Lexicon as a list in the plan."""
    found = L.match_terms(sentence_table(articles(spark, sf)), C.DEFAULT_BIAS_TERMS)
    return found.select("article_id", "sent_id",
                        N.terms_text(F.col("detected_terms")).alias("terms"))

OWNED = "SELECT doc_id AS article_id, text AS content, source AS owner FROM documents"

@query("biased_sentences_by_owner", f"""
WITH sents AS ({sentences_sql(OWNED, 'owner')}),
lists AS (SELECT 'src' || item_id AS owner, CASE WHEN item_id % 5 = 3 THEN []
          ELSE list_distinct({tokens_sql('text')}) END AS terms FROM benchmark),
m AS (SELECT article_id, sent_id, s.owner, list_sort(list_intersect({tokens_sql('sentence')},
  coalesce(l.terms, {sql_array(C.DEFAULT_BIAS_TERMS)}))) AS terms
  FROM sents s LEFT JOIN lists l ON s.owner = l.owner)
SELECT article_id, sent_id, owner, array_to_string(terms, ', ') AS terms
FROM m WHERE len(terms) > 0""")
def biased_sentences_by_owner(spark, sf):
    """Sources own articles; some have a list, of a benchmark passage or empty."""
    owned = sentence_table(articles(spark, sf, "source"), "content", "source")
    passages = table(spark, sf, "benchmark").select(
        F.concat(F.lit("src"), F.col("item_id")).alias("username"),
        F.when(F.col("item_id") % 5 == 3, F.array().cast("array<string>"))
        .otherwise(X.tokens_of(F.col("text"))).alias("terms"))
    found = L.match_owner_lexicons(
        owned.withColumnRenamed("source", "owner"),
        lexicons.explode_terms(passages, "username", "terms"), C.DEFAULT_BIAS_TERMS,
        passages.select(F.col("username").alias("owner")))
    return found.select("article_id", "sent_id", "owner",
                        N.terms_text(F.col("detected_terms")).alias("terms"))

@query("lexicon_add", rf"""
WITH have AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS owner, unnest({tokens_sql('text')}) AS k
              FROM conversations WHERE turn % 2 = 1),
parts AS (SELECT CAST(conv_id AS VARCHAR) AS owner, turn,
    regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_]') AS parts
    FROM conversations WHERE turn % 2 = 0),
words AS (SELECT owner, turn * 1000000 + unnest(range(len(parts))) AS pos,
    unnest(parts) AS term FROM parts),
asked AS (SELECT owner, lower(term) AS k, arg_min(term, pos) AS term FROM words GROUP BY 1, 2)
SELECT a.owner, a.term, CASE WHEN a.term = '' THEN 'blank'
  WHEN h.k IS NOT NULL THEN 'exists' ELSE 'added' END AS status
FROM asked a LEFT JOIN have h ON a.owner = h.owner AND a.k = h.k""")
def lexicon_add(spark, sf):
    """The words of every other turn are asked for; the turns between are the list so far."""
    turns = table(spark, sf, "conversations", "conv_id", "turn", "text")
    owner = F.col("conv_id").cast("string").alias("owner")
    have = turns.filter(F.col("turn") % 2 == 1).select(
        owner, F.explode(X.tokens_of(F.col("text"))).alias("term"))
    asked = turns.filter(F.col("turn") % 2 == 0).select(
        owner, "turn", F.posexplode(F.split("text", r"[^\p{L}\p{N}_]")).alias("nth", "term"))
    return L.add_terms(have, asked.select(
        "owner", (F.col("turn") * 1_000_000 + F.col("nth")).alias("pos"), "term"))


@query("lexicon_edit", f"""
WITH e AS (SELECT conv_id || '-' || turn AS owner,
             string_split(replace(text, ' ', chr(10)), chr(10)) AS lines FROM conversations),
l AS (SELECT owner, CAST(unnest(range(len(lines))) AS INTEGER) AS pos,
        trim(unnest(lines), {BLANKS}) AS term FROM e)
SELECT owner, min(pos) AS pos, arg_min(term, pos) AS term FROM l WHERE term <> ''
GROUP BY owner, lower(term)""")
def lexicon_edit(spark, sf):
    turns = table(spark, sf, "conversations", "conv_id", "turn", "text")
    return L.edit_lexicon(turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("owner"),
        F.replace("text", F.lit(" "), F.lit("\n")).alias("txt")))


@query("detect_techniques_table", rf"""
WITH n AS (SELECT DISTINCT array_to_string({tokens_sql('text')}[1:2], ' ') AS technique
           FROM benchmark),
d AS (SELECT doc_id AS article_id, ' ' || array_to_string({tokens_sql('text')}, ' ') || ' ' AS t
      FROM documents)
SELECT article_id, technique FROM d, n WHERE contains(t, ' ' || technique || ' ')""")
def detect_techniques_table(spark, sf):
    """The first words of the benchmark passages as a list of names in a table."""
    names = table(spark, sf, "benchmark", "text").select(F.array_join(
        F.slice(X.tokens_of(F.col("text")), 1, 2), " ").alias("technique")).distinct()
    return detect_listed_techniques(articles(spark, sf), names)


@query("detect_techniques_long", f"""
WITH n AS (SELECT DISTINCT left(w, 5) AS technique FROM (
  SELECT unnest({tokens_sql('text')}) AS w FROM conversations) WHERE length(w) > 5)
SELECT doc_id AS article_id, technique FROM documents, n WHERE contains(lower(text), technique)""")
def detect_techniques_long(spark, sf):
    """Thousands of names, the first letters of longer words of the conversations."""
    words = table(spark, sf, "conversations", "text").select(
        F.explode(X.tokens_of(F.col("text"))).alias("w")).where("length(w) > 5")
    return detect_substring_techniques(
        articles(spark, sf), words.select(F.left("w", F.lit(5)).alias("technique")).distinct())


@query("biased_sentences_long", f"""
WITH sents AS ({sentences_sql()}),
l AS (SELECT DISTINCT w AS term FROM (SELECT unnest({tokens_sql('text')}) AS w FROM conversations)
      WHERE length(w) > 6),
h AS (SELECT DISTINCT article_id, sent_id, term FROM (
  SELECT article_id, sent_id, unnest({tokens_sql('sentence')}) AS term FROM sents) JOIN l USING (term))
SELECT article_id, sent_id, string_agg(term, ', ' ORDER BY term) AS terms FROM h GROUP BY 1, 2""")
def biased_sentences_long(spark, sf):
    """A lexicon of thousands of terms, the longer words of the conversations."""
    words = table(spark, sf, "conversations", "text").select(
        F.explode(X.tokens_of(F.col("text"))).alias("term")).where("length(term) > 6")
    found = L.match_lexicon(sentence_table(articles(spark, sf)), words)
    return found.select("article_id", "sent_id",
                        N.terms_text(F.col("detected_terms")).alias("terms"))


@query("lexicon_log", rf"""
WITH log AS (SELECT 'u' || (conv_id % 10) AS owner, conv_id * 100 + turn AS seq,
    CASE conv_id % 7 WHEN 0 THEN 'edit' WHEN 3 THEN 'reset' ELSE 'add' END AS kind,
    regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_]') AS terms FROM conversations),
base AS (SELECT owner, max(seq) AS base, arg_max(kind, seq) AS base_kind
  FROM log WHERE kind <> 'add' GROUP BY owner),
held AS (SELECT owner, seq, unnest(range(len(terms))) AS pos, unnest(terms) AS term
    FROM log LEFT JOIN base USING (owner) WHERE base IS NULL OR seq > base
      OR (seq = base AND kind = 'edit')
  UNION ALL SELECT owner, base, pos, term FROM base, {DEFAULTS_SQL} l(pos, term)
    WHERE base_kind = 'reset')
SELECT owner, min(seq * 1000000 + pos) // 1000000 AS seq, min(seq * 1000000 + pos) % 1000000 AS pos,
  arg_min(term, seq * 1000000 + pos) AS term
FROM held WHERE trim(term, {BLANKS}) <> '' GROUP BY owner, lower(term)""")
def lexicon_log(spark, sf):
    """Turns as changes of ten owners' lists: some edit, some reset, most add."""
    turns = table(spark, sf, "conversations", "conv_id", "turn", "text").select(
        F.concat(F.lit("u"), F.col("conv_id") % 10).alias("owner"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), (F.col("conv_id") % 7).alias("k"),
        F.split("text", r"[^\p{L}\p{N}_]").alias("terms"))
    log = changes_of(turns.where("k = 0"), "edit").union(
        changes_of(turns.where("k = 3"), "reset")).union(
        changes_of(turns.where("k NOT IN (0, 3)"), "add"))
    return fold_changes(log, lexicons.built_in_terms())
