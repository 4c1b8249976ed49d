"""Trained models. Their results depend on the solver, so rows are checked only."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from broadsheet.catalog.base import GAZETTEER, TECHNIQUES, articles, query, table
from broadsheet.functions import fields as N
from broadsheet.functions import text as X
from broadsheet.operators import classify, features, topics
from broadsheet.operators.sentences import sentence_table
from broadsheet.operators.techniques import detect_techniques, flag_propaganda
from broadsheet.plans.annotate import annotate_corpus, topic_vectors

def labelled(spark, sf):
    rows = features.with_normalized_tokens(articles(spark, sf), features.stop_words())
    rows = flag_propaganda(detect_techniques(rows, TECHNIQUES))
    return rows.withColumn("is_train", ~features.is_test_row(F.col("article_id")))


def _train(rows):
    return classify.train_techniques(rows.filter("is_train"))


@query("train_techniques")
def train_techniques(spark, sf):
    """Test-set quality of the trained model, a row per label and average."""
    from broadsheet.operators.metrics import classification_report

    rows = labelled(spark, sf)
    model = _train(rows)
    tested = classify.predict_techniques(rows.filter(~F.col("is_train")), model)
    judged = tested.select(F.col("techniques").alias("truth"),
                           F.col("predicted_techniques").alias("pred"))
    return classification_report(judged, model.classes)


@query("predict_techniques")
def predict_techniques(spark, sf):
    rows = labelled(spark, sf)
    return classify.predict_techniques(rows, _train(rows)).select(
        "article_id", "is_train",
        N.list_text(F.col("predicted_techniques")).alias("predicted_techniques"))


@query("propaganda_lr")
def propaganda_lr(spark, sf):
    """Every sentence scored by a model trained on the labelled articles."""
    docs = articles(spark, sf)
    marks = table(spark, sf, "labels", "doc_id", "toxic").withColumnRenamed(
        "doc_id", "article_id")
    training = docs.join(marks, "article_id").select(
        X.tokens_of(F.col("content")).alias("tokens"), F.col("toxic").alias("label"))
    model = classify.train_propaganda(training)
    sentences = sentence_table(docs).withColumn("tokens", X.tokens_of(F.col("sentence")))
    return classify.score_propaganda(sentences, model, "article_id", "sent_id").withColumn(
        "score", F.round("score", 6))


@query("topic_kmeans")
def topic_kmeans(spark, sf):
    """Given vectors, clustered."""
    vectors = table(spark, sf, "embeddings").select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = topics.fit_topics(vectors, topics=10)
    return topics.assign_topics(vectors, model).select(
        "vec_id", "topic", F.round("distance", 6).alias("distance"))


@query("doc_topics")
def doc_topics(spark, sf):
    """Articles clustered by their TF-IDF vectors, one topic for each."""
    docs = features.with_normalized_tokens(articles(spark, sf), features.stop_words())
    vectors = topic_vectors(docs)
    model = topics.fit_topics(vectors, features="topic_features")
    placed = topics.assign_topics(vectors, model, "topic_features")
    return topics.attach_topics(docs.select("article_id"), placed)


@query("annotate_corpus")
def annotate(spark, sf):
    """The whole corpus annotation."""
    done = annotate_corpus(articles(spark, sf, "source"), techniques=TECHNIQUES,
                           gazetteer=GAZETTEER, stop_words=features.stop_words())
    return done.articles.select(
        "article_id", "source", "processed_content", "is_propaganda", "is_train", "topic",
        N.list_text(F.col("techniques")).alias("techniques"),
        N.list_text(F.col("predicted_techniques")).alias("predicted_techniques"),
        "entities_text", "indicators_text")
