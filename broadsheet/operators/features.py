"""Term statistics, TF-IDF, labels, and the train/test split."""

from __future__ import annotations

import json

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.functions import unwrap_udt

from broadsheet import constants as C
from broadsheet.functions import text as X
from broadsheet.operators.unnest import unnest

# A vocabulary up to this many rows is collected and handed to every task.
BROADCAST_ROWS = 100_000


def stop_words() -> list[str]:
    """The fixed English stop words, the same for every Spark version."""
    return list(C.STOP_WORDS)


def with_normalized_tokens(articles: DataFrame, words, text: str = "content",
                           output: str = "tokens", lemma=X.lemma_by_suffix) -> DataFrame:
    """Adds the normalised tokens and, as ``processed_content``, their text."""
    return (articles.withColumn(output, X.normalized_tokens(text, words, lemma))
            .withColumn("processed_content", F.array_join(output, " ")))


def split_tokens(processed: str) -> Column:
    """The tokens of a ``processed_content``; none holds a space or is empty."""
    return F.when(F.col(processed) == "", F.array().cast("array<string>")).otherwise(
        F.split(processed, " "))


def lemmatize(tokens: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Tall tokens (``term``) through a dictionary ``term, lemma`` of any size.

    Terms the dictionary lacks stay. No broadcast is forced; the optimiser
    picks the join by size, and AQE splits the partitions of frequent words.
    """
    return (tokens.join(lemmas, "term", "left")
            .withColumn("term", F.coalesce("lemma", "term")).drop("lemma"))


def feature_terms(text: str) -> Column:
    """Lower-case tokens of at least two characters, repeats kept."""
    return F.expr(f"filter({X.tokens_sql(text)}, t -> length(t) >= 2)")


def term_frequencies(articles: DataFrame, terms: Column) -> DataFrame:
    """``article_id, term, tf``. Counted per task first; no text is shuffled."""
    pairs = unnest(articles, terms, "article_id", value="term")
    return pairs.groupBy("article_id", "term").agg(F.count("*").alias("tf"))


def counted_terms(rows: DataFrame, terms: Column, *keep: str) -> DataFrame:
    """``keep``, ``term``, ``n``: each distinct term of a row with its count in that row.

    The list is sorted inside the row and its runs are counted, so a row is multiplied
    by its distinct terms only. NULL terms are no terms.
    """
    ordered = rows.select(*keep, F.sort_array(F.filter(
        terms, lambda term: term.isNotNull())).alias("_terms"))
    heads = ordered.select(*keep, "_terms", F.expr(
        "filter(transform(_terms, (t, i) -> CASE WHEN i = 0 OR t <> _terms[i - 1] THEN i END), "
        "i -> i IS NOT NULL)").alias("_heads"))
    runs = F.expr("transform(_heads, (h, k) -> struct(_terms[h] AS term, "
                  "coalesce(get(_heads, k + 1), size(_terms)) - h AS n))")
    return unnest(heads, runs, *keep, value="_run").select(
        *keep, F.col("_run.term").alias("term"), F.col("_run.n").alias("n"))


def term_stats(articles: DataFrame, terms: Column) -> DataFrame:
    """Corpus frequency and document frequency per term, in one pass.

    Every article gives each distinct token once, with its count. Both figures are
    summed per task, so even the commonest word is one row per task in the only
    shuffle, and no article moves.
    """
    return (counted_terms(articles, terms).groupBy("term")
            .agg(F.sum("n").alias("term_frequency"), F.count("*").alias("document_frequency")))


def vocabulary(stats: DataFrame, size: int = C.MAX_FEATURES) -> DataFrame:
    """The ``size`` most frequent terms; equal counts in term order."""
    return stats.orderBy(F.col("term_frequency").desc(), "term").limit(size)


def smooth_idf(documents: Column, document_frequency: Column) -> Column:
    return F.log((documents + 1) / (document_frequency + 1)) + 1


def weighted_vocabulary(articles: DataFrame, terms: Column, size: int) -> DataFrame:
    """``term, idf`` of the vocabulary, most frequent first; one shuffle, of term counts."""
    documents = articles.agg(F.count("*").alias("n")).scalar()
    return vocabulary(term_stats(articles, terms), size).select(
        "term", smooth_idf(documents, F.col("document_frequency")).alias("idf"))


def tfidf(articles: DataFrame, terms: Column,
          size: int = C.MAX_FEATURES) -> DataFrame:
    """``article_id, term, weight`` with rows of length one.

    The vocabulary comes from ``term_stats``, whose only shuffle has a row per term
    and task. Up to ``BROADCAST_ROWS`` terms it is collected, and counts, weights and
    length of an article are made inside its row, so no article and no pair is shuffled.
    A longer vocabulary stays a table: words are joined to it, and ids, kept terms and
    counts are shuffled. A missing list has no terms.
    """
    terms = F.coalesce(terms, F.array().cast("array<string>"))
    vocab = weighted_vocabulary(articles, terms, size)
    if size > BROADCAST_ROWS:
        return _tfidf_by_join(articles, terms, vocab)
    rows = vocab.collect()
    model = _weighting(rows, "_terms", "_vector")
    listed = articles.select("article_id", terms.alias("_terms"))
    if model is None:
        return listed.where("false").select(
            "article_id", F.lit("").alias("term"), F.lit(0.0).alias("weight"))
    vector = unwrap_udt(F.col("_vector"))
    entries = F.arrays_zip(vector.getField("indices").alias("at"),
                           vector.getField("values").alias("weight"))
    names = F.from_json(F.lit(json.dumps([row.term for row in rows])), "array<string>")
    return unnest(model.transform(listed), entries, "article_id", value="e").select(
        "article_id", F.get(names, F.col("e.at")).alias("term"),
        F.col("e.weight").alias("weight"))


def _tfidf_by_join(articles: DataFrame, terms: Column, vocab: DataFrame) -> DataFrame:
    pairs = unnest(articles, terms, "article_id", value="term")
    raw = (pairs.join(vocab, "term").groupBy("article_id", "term")
           .agg(F.count("*").alias("tf"), F.first("idf").alias("idf"))
           .select("article_id", "term", (F.col("tf") * F.col("idf")).alias("raw")))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(
        Window.partitionBy("article_id")))
    return raw.select("article_id", "term", (F.col("raw") / length).alias("weight"))


def _weighting(rows, tokens: str, output: str) -> PipelineModel | None:
    """Token lists to weighted vectors of length one; ``None`` without any term."""
    if not rows:
        return None
    counts = CountVectorizerModel.from_vocabulary(
        [row.term for row in rows], inputCol=tokens, outputCol=f"{output}_tf")
    weights = ElementwiseProduct(
        scalingVec=Vectors.dense([row.idf for row in rows]),
        inputCol=f"{output}_tf", outputCol=f"{output}_raw")
    norm = Normalizer(p=2.0, inputCol=f"{output}_raw", outputCol=output)
    return PipelineModel([counts, weights, norm])


def fit_tfidf(articles: DataFrame, tokens: str = "tokens", output: str = "features",
              size: int = C.MAX_FEATURES) -> PipelineModel | None:
    """The same weights as an ML model that maps a token list to a vector.

    Only the vocabulary with its weights, at most ``size`` rows, comes to the
    driver. ``None`` when the corpus has no term.
    """
    terms = F.filter(F.col(tokens), lambda token: F.length(token) >= 2)
    return _weighting(weighted_vocabulary(articles, terms, size).collect(), tokens, output)


def fit_tfidf_twice(articles: DataFrame, part: str, first: str, second: str,
                    tokens: str = "tokens", size: int = C.MAX_FEATURES,
                    ) -> tuple[PipelineModel | None, PipelineModel | None]:
    """``fit_tfidf`` of all rows, to ``first``, and of those with ``part``, to ``second``.

    Terms are counted for both in one pass with one shuffle; the counts, a row for each
    term, are on disk until both are read.
    """
    terms = F.filter(F.col(tokens), lambda token: F.length(token) >= 2)
    inside = F.col(part)
    total, some = articles.agg(F.count("*"), F.count_if(inside)).first()
    stats = counted_terms(articles, terms, part).groupBy("term").agg(
        F.sum("n").alias("n0"), F.count("*").alias("d0"),
        F.sum(F.when(inside, F.col("n"))).alias("n1"), F.count_if(inside).alias("d1"))
    stats = stats.persist(StorageLevel.DISK_ONLY)
    try:
        return tuple(
            _weighting(vocabulary(stats.where(f"d{i} > 0").select(
                "term", F.col(f"n{i}").alias("term_frequency"),
                smooth_idf(F.lit(documents), F.col(f"d{i}")).alias("idf")), size).collect(),
                tokens, output)
            for i, (documents, output) in enumerate(((total, first), (some, second))))
    finally:
        stats.unpersist()


# --- Labels ------------------------------------------------------------------

def label_vocabulary(labelled: DataFrame, labels: str = "techniques") -> DataFrame:
    """Distinct labels; sort them where order matters."""
    return unnest(labelled, labels, value="label").distinct()


def label_names(labelled: DataFrame, labels: str = "techniques") -> list[str]:
    """The sorted class list; as short as the technique list it comes from."""
    return sorted(row.label for row in label_vocabulary(labelled, labels).collect())


def binarize(labels: Column, classes) -> Column:
    """0/1 per class, in class order."""
    return F.array(*[F.array_contains(labels, name).cast("int") for name in classes])


def labels_of(flags: Column, classes) -> Column:
    """The inverse: names of the classes whose flag is 1, in class order."""
    named = [F.when(F.get(flags, F.lit(i)) == 1, F.lit(name))
             for i, name in enumerate(classes)]
    if not named:
        return F.array().cast("array<string>")
    return F.array_except(F.array(*named), F.array(F.lit(None).cast("string")))


def is_test_row(key: Column, share: float = 0.2) -> Column:
    """A fixed share of rows by hash of the key: stable under any partitioning.

    The first two hex digits of the MD5 are compared, so the share is met to
    the nearest 256th.
    """
    limit = format(round(share * 256), "02x")
    return F.substring(F.md5(key.cast("string")), 1, 2) < limit
