"""Sentences, tokens, folding, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.catalog.base import (
    BLANKS,
    FOLDED,
    articles,
    query,
    sentences_sql,
    table,
    tokens_sql,
)
from broadsheet.functions import predicates as P
from broadsheet.functions import scores as S
from broadsheet.functions import text as X
from broadsheet.operators import abbreviations as A
from broadsheet.operators import sentences as O
from broadsheet.session import short_batches
from broadsheet.sources import corpus, pages


@query("sentences", f"WITH sents AS ({sentences_sql()}) SELECT * FROM sents")
def sentences(spark, sf):
    return O.sentence_table(articles(spark, sf))


@query("tokens", f"""WITH sents AS ({sentences_sql()})
SELECT article_id, sent_id, unnest(list_distinct({tokens_sql('sentence')})) AS term FROM sents""")
def tokens(spark, sf):
    return O.token_table(O.sentence_table(articles(spark, sf)))


# Wider than by default, as the invented words of the test corpus are long.
RULES = {"longest": 8, "least": 5, "percent": 60, "most": 10_000}
BARE_SQL = r"regexp_replace(lower({0}), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')"
STOPS_SQL = rf"""
words AS (SELECT unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents),
stats AS (SELECT {BARE_SQL.format('word')} AS term,
  count(*) FILTER (word LIKE '%.') AS before_stop,
  count(*) FILTER (word NOT LIKE '%.') AS elsewhere FROM words GROUP BY 1 HAVING term <> ''),
verdicts AS (SELECT *, length(term) <= 8 AND before_stop >= 5
  AND NOT regexp_matches(term, '\p{{N}}') AND 100 * before_stop >= 60 * (before_stop + elsewhere)
  AND before_stop * 10000 >= (SELECT sum(before_stop) FROM stats) AS is_abbreviation
  FROM stats)"""


@query("abbreviations", f"WITH {STOPS_SQL} SELECT * FROM verdicts")
def abbreviations(spark, sf):
    return A.with_verdict(A.full_stop_stats(articles(spark, sf)), **RULES)


@query("sentences_by_abbreviations", rf"""WITH {STOPS_SQL},
sents AS ({sentences_sql()}),
ends AS (SELECT *, sentence LIKE '%.' AND {BARE_SQL.format(
    r"regexp_extract(sentence, '([^ \t\n\r\f]+)$', 1)")}
  IN (SELECT term FROM verdicts WHERE is_abbreviation) AS abbreviated FROM sents),
parts AS (SELECT *, coalesce(sum(CASE WHEN abbreviated THEN 0 ELSE 1 END) OVER (
  PARTITION BY article_id ORDER BY sent_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  AS part FROM ends)
SELECT article_id, CAST(part AS INTEGER) AS sent_id,
  string_agg(sentence, ' ' ORDER BY sent_id) AS sentence FROM parts GROUP BY article_id, part""")
def sentences_by_abbreviations(spark, sf):
    docs = articles(spark, sf)
    return A.sentence_table_by(docs, A.learn_abbreviations(docs, **RULES))


@query("sentence_counts", f"""WITH sents AS ({sentences_sql()})
SELECT d.doc_id AS article_id, CAST(coalesce(n, 0) AS INTEGER) AS total_sentences
FROM documents d LEFT JOIN (SELECT article_id, count(*) AS n FROM sents GROUP BY 1) s
ON d.doc_id = s.article_id""")
def sentence_counts(spark, sf):
    return O.sentence_counts(articles(spark, sf))


@query("ascii_fold", f"SELECT article_id, content AS folded FROM ({FOLDED})")
def ascii_fold(spark, sf):
    return articles(spark, sf).select(
        "article_id", X.ascii_fold(F.col("content")).alias("folded"))


# Each text whole, its white space only, and its sharp s only: the last has
# characters, but none that outlives folding.
VARIANTS_SQL = r"""SELECT doc_id * 3 + v AS article_id, CASE v WHEN 0 THEN text
  WHEN 1 THEN regexp_replace(text, '\S', '', 'g')
  ELSE regexp_replace(text, '[^ß]', '', 'g') END AS content
  FROM documents, (VALUES (0), (1), (2)) t(v)"""


@query("rejected_articles", rf"""
SELECT article_id, CASE WHEN trim(content, {BLANKS}) = '' THEN 'no_text'
  ELSE 'no_sentences' END AS reason FROM ({VARIANTS_SQL})
WHERE trim(regexp_replace(strip_accents(content), '[^\x00-\x7F]', '', 'g'),
           {BLANKS}) = ''""")
def rejected_articles(spark, sf):
    text = F.col("content")
    variants = F.posexplode(F.array(
        text, F.regexp_replace(text, r"\S", ""), F.regexp_replace(text, "[^ß]", "")))
    rows = articles(spark, sf).select("article_id", variants.alias("v", "content"))
    return O.rejected_articles(rows.select(
        (F.col("article_id") * 3 + F.col("v")).alias("article_id"), "content"))


@query("valid_urls", r"""
WITH v AS (SELECT page_id, unnest([url, regexp_replace(url, '^https?:', ''),
    regexp_replace(url, '^https?://', ''), regexp_replace(url, '//[^/]*', '//'),
    '']) AS url FROM pages)
SELECT page_id, url, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') AS is_valid
FROM v""")
def valid_urls(spark, sf):
    url = F.col("url")
    forms = F.array(url, F.regexp_replace(url, "^https?:", ""),
                    F.regexp_replace(url, "^https?://", ""),
                    F.regexp_replace(url, "//[^/]*", "//"), F.lit(""))
    rows = table(spark, sf, "pages", "page_id", "url").select(
        "page_id", F.explode(forms).alias("url"))
    return rows.withColumn("is_valid", P.is_url(F.col("url")))


@query("valid_emails", r"""
WITH w AS (SELECT doc_id AS article_id, unnest(regexp_split_to_array(text, '\s+')) AS word
           FROM documents)
SELECT article_id, word, regexp_matches(word, '^[^@]+@[^@]+\.[^@]+$') AS is_valid FROM w""")
def valid_emails(spark, sf):
    words = articles(spark, sf).select(
        "article_id", F.explode(F.split("content", r"\s+")).alias("word"))
    return words.withColumn("is_valid", P.is_email(F.col("word")))


@query("stars_map", """
WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL
    WHEN l_linenumber = 1 THEN '1 star' ELSE l_linenumber || ' stars' END AS label
  FROM lineitem)
SELECT *, CASE WHEN label IN ('1 star', '2 stars', '3 stars', '4 stars', '5 stars')
  THEN CAST(left(label, 1) AS INTEGER) ELSE 3 END AS stars FROM l""")
def stars_map(spark, sf):
    number = F.col("l_linenumber")
    label = (F.when(number == 7, F.lit(None).cast("string")).when(number == 1, "1 star")
             .otherwise(F.concat(number.cast("string"), F.lit(" stars"))))
    rows = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber")
    return (rows.withColumn("label", label)
            .withColumn("stars", S.star_value(F.col("label"))))


# --- Pages ---------------------------------------------------------------------

NOISE_SQL = (r"(?is)<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>"
             r"|<!--.*?-->")


PAGE_TEXT_SQL = rf"""
c AS (SELECT page_id, regexp_replace(html, '{NOISE_SQL}', '<>', 'g') AS h FROM pages),
-- an unclosed paragraph reaches to the end of its article
b AS (SELECT page_id, CASE
    WHEN len(regexp_extract_all(h, '(?i)<p[\s>]')) > len(regexp_extract_all(h, '(?i)</p>'))
    THEN regexp_extract(h, '(?is)<p(?:\s[^>]*)?>.*?</article\s*>')
    ELSE array_to_string(regexp_extract_all(h, '(?is)<p(?:\s[^>]*)?>.*?</p\s*>'), '<p>') END
    AS body FROM c),
p AS (SELECT page_id, list_filter(list_transform(string_split(
    regexp_replace(body, '(?s)<[^>]*>', chr(1), 'g'), chr(1)),
    lambda x: trim(x, {BLANKS})), lambda x: x <> '') AS pieces FROM b),
texts AS (SELECT page_id, replace(replace(replace(replace(array_to_string(pieces, ' '),
  '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS content FROM p)"""


@query("page_text", f"WITH {PAGE_TEXT_SQL} SELECT * FROM texts")
def page_text(spark, sf):
    short_batches(spark)
    rows = table(spark, sf, "pages", "page_id", "html")
    return rows.select("page_id", pages.page_text("html").alias("content"))


@query("page_articles", f"""WITH {PAGE_TEXT_SQL}
SELECT page_id, url, content, CASE
  WHEN NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') THEN 'invalid_url'
  WHEN content = '' THEN 'no_content' END AS reason FROM texts JOIN pages USING (page_id)""")
def page_articles(spark, sf):
    return pages.page_articles(table(spark, sf, "pages", "page_id", "url", "html"))


# --- Corpus shape ----------------------------------------------------------------

@query("src_corpus_flatten", """
SELECT doc_id, text AS content, source, lang AS meta_lang, n_chars AS meta_size_chars
FROM documents""")
def src_corpus_flatten(spark, sf):
    """Records as JSON text, parsed, flattened, and the title taken as content."""
    docs = table(spark, sf, "documents")
    record = F.struct("doc_id", F.col("text").alias("Title"), "source", F.struct(
        "lang", F.struct(F.col("n_chars").alias("chars")).alias("size")).alias("meta"))
    schema = ("doc_id bigint, Title string, source string, "
              "meta struct<lang:string, size:struct<chars:bigint>>")
    parsed = docs.select(F.from_json(F.to_json(record), schema).alias("r")).select("r.*")
    flat = corpus.reconcile_content(corpus.flatten(parsed))
    return flat.withColumnsRenamed({name: name.replace(".", "_") for name in flat.columns})
