"""Corpus annotation, end to end: one lazy plan of added columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet import constants as C
from broadsheet.functions import fields as N
from broadsheet.operators import classify, entities, features, topics
from broadsheet.operators.techniques import detect_techniques, flag_propaganda
from broadsheet.sources.corpus import with_missing_columns


@dataclass(frozen=True)
class Annotated:
    """The annotated articles, the topic table, and the trained model."""

    articles: DataFrame
    topic_info: DataFrame
    model: classify.TechniqueModel


def annotate_text(articles: DataFrame, *, techniques=C.DEFAULT_TECHNIQUES,
                  gazetteer: dict[str, str], stop_words) -> DataFrame:
    """Everything that needs only the article itself. A map over the rows."""
    prepared = features.with_normalized_tokens(articles, stop_words)
    detected = flag_propaganda(detect_techniques(prepared, techniques))
    return entities.inline_entities(detected, gazetteer)


def topic_features(articles: DataFrame, size: int = C.MAX_FEATURES) -> PipelineModel:
    """Maps tokens to vectors for clustering: TF-IDF of the terms, length one, sparse."""
    return _or_empty(features.fit_tfidf(articles, output="topic_features", size=size))


def _or_empty(model: PipelineModel | None) -> PipelineModel:
    return model or PipelineModel([CountVectorizerModel.from_vocabulary(
        [""], inputCol="tokens", outputCol="topic_features")])


def topic_vectors(articles: DataFrame, size: int = C.MAX_FEATURES) -> DataFrame:
    """Article vectors for clustering."""
    return topic_features(articles, size).transform(articles).drop(
        "topic_features_tf", "topic_features_raw")


def annotate_corpus(articles: DataFrame, *, techniques=C.DEFAULT_TECHNIQUES,
                    gazetteer: dict[str, str], stop_words,
                    n_topics: int = C.DEFAULT_TOPICS, smallest_topic: int = 2,
                    max_features: int = C.MAX_FEATURES,
                    svm_iterations: int = C.SVM_ITERATIONS) -> Annotated:
    """The whole annotation.

    The model is trained on the training rows only; every row gets a
    prediction and ``is_train`` tells the two apart. Fitting the classifier
    and the clusters are the only actions; the rest is lazy.
    """
    articles = with_missing_columns(articles)
    annotated = annotate_text(articles, techniques=techniques,
                              gazetteer=gazetteer, stop_words=stop_words)
    annotated = annotated.withColumn(
        "is_train", ~features.is_test_row(F.col("article_id")))
    # Tokens are made once for the clusters and the classifier; a lost part is made again.
    # They are kept as their text, a quarter of the list, and on disk: in memory the bytes
    # of a cache may take twice what Spark counts, as the collector gives large arrays whole
    # regions.
    kept = annotated.select("processed_content", "techniques", "is_train").persist(
        StorageLevel.DISK_ONLY)
    listed = kept.withColumn("tokens", features.split_tokens("processed_content"))
    try:
        fitted, weights = features.fit_tfidf_twice(
            listed, "is_train", "topic_features", "features", size=max_features)
        vectorizer = _or_empty(fitted)
        clusters = topics.fit_topics(vectorizer.transform(listed), features="topic_features",
                                     topics=n_topics, smallest=smallest_topic)
        model = classify.train_prepared(listed.filter("is_train"), kept, size=max_features,
                                        max_iter=svm_iterations, model=weights)
    finally:
        kept.unpersist()
    predicted = classify.predict_techniques(annotated, model)
    vectors = vectorizer.transform(predicted).drop("topic_features_tf", "topic_features_raw")
    placed = topics.assign_topics(vectors, clusters, "topic_features")
    info = topics.topic_overview(topics.topic_counts(placed))
    flat = placed.withColumns({
        "entities_text": N.entities_text(F.col("entities")),
        "indicators_text": N.list_text(F.col("indicators")),
    }).drop("topic_features", "distance", "tokens")
    return Annotated(flat, info, model)
