"""Registry, input tables, fixed test lists, and shared SQL pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet import constants as C
from broadsheet.operators.scorers import TermPropaganda, ValenceStars
from broadsheet.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` it is checked by its rows only."""
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


# --- Fixed lists: words of the test corpus, so that every branch is hit -------
POSITIVE = ("with", "for", "que", "la", "und", "the")
NEGATIVE = ("of", "and", "is", "los", "der", "de", "pour", "le")
PROPAGANDA = ("thing", "attion", "erble", "disgusting", "stupid", "vile",
              "heit", "tion", "ado")
TECHNIQUES = ("with the", "in that", "que la", "die und", "le de",
              "Repetitive Phrasing", "Loaded Language", "The And", "un la",
              "STUPID")
GAZETTEER = {"attion": "ORG", "erble": "PERSON", "thing": "PRODUCT",
             "with the": "ORG", "que la": "GPE"}

STARS = ValenceStars(POSITIVE, NEGATIVE)
TERMS = TermPropaganda(PROPAGANDA)
SCORING = {"bias_terms": C.DEFAULT_BIAS_TERMS, "stars": STARS, "propaganda": TERMS}


# --- Input tables -------------------------------------------------------------

def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet", *columns)


def articles(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    """Documents as articles, at the width of the scan."""
    docs = table(spark, sf, "documents", "doc_id", "text", *extra)
    return docs.withColumnsRenamed({"doc_id": "article_id", "text": "content"})


def rounded(name: str):
    return F.round(F.col(name), 6).alias(name)


# --- SQL pieces ---------------------------------------------------------------

BLANKS = r"(E' \t\n\r\f' || chr(11))"


def sql_values(items) -> str:
    return ", ".join("'" + item.replace("'", "''") + "'" for item in items)


def sql_array(items) -> str:
    return f"[{sql_values(items)}]"


TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


def tokens_sql(column: str) -> str:
    return TOKENS.format(column)


def sentences_sql(source: str = "SELECT doc_id AS article_id, text AS content FROM documents",
                  keep: str = "") -> str:
    """CTE body: sentences of a select with ``article_id, content``."""
    keep = f"{keep}, " if keep else ""
    return rf"""
SELECT {keep}article_id, CAST(nth AS INTEGER) AS sent_id,
       regexp_replace(raw, '^\s+|\s+$', '', 'g') AS sentence
FROM (SELECT {keep}article_id, unnest(parts) AS raw, unnest(range(len(parts))) AS nth
      FROM (SELECT {keep}article_id,
                   string_split(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'),
                                chr(1)) AS parts
            FROM ({source})))
WHERE regexp_replace(raw, '^\s+|\s+$', '', 'g') <> ''"""


FOLDED = (r"SELECT doc_id AS article_id, "
          r"regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g') AS content "
          r"FROM documents")


def hits_sql(source: str | None = None, keep: str = "") -> str:
    """CTEs ``sents`` and ``hits``: per sentence, terms and term counts."""
    body = sentences_sql(source, keep) if source else sentences_sql(keep=keep)
    return f"""
sents AS ({body}),
toks AS (SELECT *, list_distinct({tokens_sql('sentence')}) AS toks FROM sents),
hits AS (SELECT *,
  list_sort(list_intersect(toks, {sql_array(C.DEFAULT_BIAS_TERMS)})) AS terms,
  least(5, greatest(1, 3 + len(list_intersect(toks, {sql_array(POSITIVE)}))
                         - len(list_intersect(toks, {sql_array(NEGATIVE)})))) AS stars,
  len(list_intersect(toks, {sql_array(PROPAGANDA)})) AS h FROM toks)"""


def totals_sql(keys: str = "article_id") -> str:
    """CTEs ``sums`` and ``totals`` on top of ``hits``: figures per article."""
    return f"""
sums AS (SELECT {keys}, count(*) AS n, sum(stars) AS stars,
  count(*) FILTER (len(terms) > 0) AS bias_score,
  count(*) FILTER (h / (h + 0.1) >= 0.9) AS propaganda_score,
  coalesce(string_agg(sentence || ' [' || array_to_string(terms, ', ') || ']', ' | '
           ORDER BY sent_id) FILTER (len(terms) > 0), '') AS biased_detail
  FROM hits GROUP BY {keys}),
totals AS (SELECT *, CASE WHEN sentiment_score >= 3.5 THEN 'Positive'
    WHEN sentiment_score <= 2.5 THEN 'Negative' ELSE 'Neutral' END AS sentiment_label,
  greatest(0.0, least(100.0, (sentiment_score - 1) / 4 * 100
    - bias_score / n * 50.0 - propaganda_score / n * 50.0)) AS final_score
  FROM (SELECT *, CAST(printf('%.2f', stars / n) AS DOUBLE) AS sentiment_score FROM sums))"""


def detected_sql(column: str = "text") -> str:
    """List of detected technique names in list order."""
    usable = [n for n in TECHNIQUES if n.lower() != C.EXCLUDED_TECHNIQUE]
    return (f"list_filter({sql_array(usable)}, lambda t: contains(lower({column}), lower(t)))")


def whole_sql(column: str = "text") -> str:
    """Names standing between non-letters."""
    usable = [n for n in TECHNIQUES if n.lower() != C.EXCLUDED_TECHNIQUE]
    spaced = (rf"' ' || regexp_replace(lower({column}), '[^\p{{L}}\p{{N}}_]', ' ', 'g') || ' '")
    return f"list_filter({sql_array(usable)}, lambda t: contains({spaced}, ' ' || lower(t) || ' '))"
