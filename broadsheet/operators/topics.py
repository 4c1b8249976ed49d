"""Topics: clusters of articles, their sizes, and their names."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.functions import unwrap_udt

from broadsheet import constants as C

OUTLIER = -1


def class_tfidf(tokens: DataFrame) -> DataFrame:
    """``topic, term, tf, score`` from tall ``topic, term`` rows.

    Class-based TF-IDF: ``tf(t,c) * ln(1 + A / f(t))``, with ``A`` the mean
    number of words per class. Counts per (topic, term) are made first; all
    later steps work on those, so a topic with most of the corpus costs no more
    than its vocabulary.
    """
    return _class_scores(tokens.groupBy("topic", "term").agg(F.count("*").alias("tf")))


def _class_scores(counts: DataFrame) -> DataFrame:
    """Adds ``score``. A NULL term counts the articles of a topic and is no word.

    The mean reads the same counts, column for column, so their shuffle is made once.
    """
    words = F.when(F.col("term").isNotNull(), F.col("tf"))
    mean_words = counts.agg(
        (F.sum(words) / F.count_distinct(F.when(F.col("term").isNotNull(), F.col("topic"))))
        .alias("a")).scalar()
    # a term's rows are at most one per topic
    frequency = F.sum("tf").over(Window.partitionBy("term"))
    return counts.select(
        "topic", "term", "tf",
        (F.col("tf") * F.log(1 + mean_words / frequency)).alias("score"))


def topic_words(scored: DataFrame, words: int = 4) -> DataFrame:
    """The best ``words`` terms per topic with their rank.

    The rank limit is pushed below the shuffle: a task passes on its own best
    few per topic, not the topic's vocabulary.
    """
    best = Window.partitionBy("topic").orderBy(F.col("score").desc(), "term")
    return (scored.withColumn("rank", F.row_number().over(best))
            .filter(F.col("rank") <= words))


def topic_counts(articles: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``topic, term, tf`` of articles with ``topic``, in one pass.

    The row of a topic with a NULL term counts its articles. Sums are taken in each task
    first, so a topic with most articles sends one row per term and task.
    """
    known = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    marked = F.concat(F.filter(known, lambda t: t.isNotNull()),
                      F.array(F.lit(None).cast("string")))
    return (articles.select("topic", F.explode_outer(marked).alias("term"))
            .groupBy("topic", "term").agg(F.count("*").alias("tf")))


def topic_overview(counts: DataFrame, words: int = 4) -> DataFrame:
    """``topic, count, name`` from ``topic_counts``: articles per topic, and its best words.

    The article row of a topic comes first, before its words, so one ranking, limited
    below the shuffle, gives both. The name is ``<topic>_<word>_<word>…``, NULL for a
    topic without words.
    """
    scored = _class_scores(counts).withColumn(
        "score", F.when(F.col("term").isNull(), float("inf")).otherwise(F.col("score")))
    ranked = topic_words(scored, words + 1)
    word = F.when(F.col("term").isNotNull(), F.struct("rank", "term"))
    found = ranked.groupBy("topic").agg(
        F.max(F.when(F.col("term").isNull(), F.col("tf"))).alias("count"),
        F.array_sort(F.collect_list(word)).alias("top"))
    label = F.concat_ws("_", F.col("topic").cast("string"), F.col("top.term"))
    return found.select("topic", "count", F.when(F.size("top") > 0, label).alias("name"))


def topic_info(assigned: DataFrame, tokens: DataFrame, words: int = 4) -> DataFrame:
    """``topic, count, name`` where articles and words come apart.

    ``assigned`` has a row per article, ``tokens`` a row per token; both with
    ``topic``. Topics without articles are left out.
    """
    marks = assigned.select("topic", F.lit(None).cast("string").alias("term"))
    counts = (marks.unionByName(tokens.select("topic", "term").where("term IS NOT NULL"))
              .groupBy("topic", "term").agg(F.count("*").alias("tf")))
    return topic_overview(counts, words).where("count IS NOT NULL")


def renumber_by_size(sizes: dict[int, int], smallest: int) -> dict[int, int]:
    """Cluster numbers to topic numbers: by size, too small ones to the outlier."""
    kept = sorted((c for c, n in sizes.items() if n >= smallest),
                  key=lambda c: (-sizes[c], c))
    return {c: kept.index(c) if c in kept else OUTLIER for c in sizes}


@dataclass(frozen=True)
class TopicModel:
    """Clusters, the topic each one became, and the outlier distance."""

    clusters: KMeansModel
    numbers: dict[int, int]
    cutoff: float


def _clustered(rows: DataFrame, clusters: KMeansModel, features: str) -> DataFrame:
    """Adds ``cluster`` and the squared distance to its centre.

    Centres are looked up at the values a vector has, so a sparse one stays sparse.
    """
    centers = np.stack(clusters.clusterCenters())
    squares = (centers * centers).sum(axis=1)

    @F.pandas_udf("double")
    def distance(indices: pd.Series, values: pd.Series, cluster: pd.Series) -> pd.Series:
        sizes = np.fromiter(map(len, indices), np.int64, len(indices))
        if not sizes.sum():
            return pd.Series(squares[cluster.to_numpy()])
        rows = np.repeat(np.arange(len(sizes)), sizes)
        value = np.concatenate(values.to_numpy()).astype(np.float64)
        center = centers[cluster.to_numpy()[rows], np.concatenate(indices.to_numpy())]
        parts = np.bincount(rows, value * (value - 2 * center), len(sizes))
        return pd.Series(np.maximum(0.0, squares[cluster.to_numpy()] + parts))

    parts = unwrap_udt(F.col(features))
    values = parts.getField("values")
    indices = F.coalesce(parts.getField("indices"), F.when(
        F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(
            F.array().cast("array<int>")))
    return clusters.transform(rows).withColumn(
        "distance", distance(indices, values, F.col("cluster")))


def fit_topics(rows: DataFrame, *, features: str = "features",
               topics: int = C.DEFAULT_TOPICS, smallest: int = 2,
               outlier_share: float = 0.02, seed: int = 42) -> TopicModel:
    """K-means on dense or sparse vectors.

    Rows farther from their centre than all but ``outlier_share`` of rows, and
    clusters below ``smallest`` articles, become the outlier topic. Only the
    ``topics`` centres and sizes come to the driver.
    """
    rows = rows.select(features).persist(StorageLevel.DISK_ONLY)
    try:
        clusters = KMeans(k=topics, seed=seed, featuresCol=features,
                          predictionCol="cluster").fit(rows)
        found = _clustered(rows, clusters, features)
        cutoff = found.agg(F.percentile_approx(
            "distance", 1.0 - outlier_share, 10_000)).first()[0]
        sizes = {row.cluster: row["count"]
                 for row in found.filter(F.col("distance") <= cutoff)
                 .groupBy("cluster").count().collect()}
    finally:
        rows.unpersist()
    return TopicModel(clusters, renumber_by_size(sizes, smallest), cutoff)


def assign_topics(rows: DataFrame, model: TopicModel,
                  features: str = "features") -> DataFrame:
    """Adds ``topic`` and ``distance``, one topic per row. A map over the rows."""
    number = F.lit(OUTLIER)
    for cluster, topic in model.numbers.items():
        number = F.when(F.col("cluster") == cluster, topic).otherwise(number)
    topic = F.when(F.col("distance") <= model.cutoff, number).otherwise(OUTLIER)
    return (_clustered(rows, model.clusters, features)
            .withColumn("topic", topic.cast("int")).drop("cluster"))


def attach_topics(articles: DataFrame, topics: DataFrame) -> DataFrame:
    """One topic per article by id; NULL where there is none."""
    return articles.join(topics.select("article_id", "topic"), "article_id", "left")
