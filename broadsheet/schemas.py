"""Schemas of the tables that cross module borders."""

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())

ARTICLES = T.StructType([
    T.StructField("article_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("indicators", STRINGS),
])

ENTITIES = T.ArrayType(T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("label", T.StringType()),
]))

BIASED_SENTENCES = T.ArrayType(T.StructType([
    T.StructField("sentence", T.StringType()),
    T.StructField("detected_terms", STRINGS),
]))

# Superset of every generation of the saved records: newer rows carry
# label/score, older ones parallel technique/score lists.
PROPAGANDA_SENTENCES = T.ArrayType(T.StructType([
    T.StructField("sentence", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("label", T.StringType()),
    T.StructField("detected_techniques", STRINGS),
    T.StructField("scores", T.ArrayType(T.DoubleType())),
]))

# What an analysis run writes.
ANALYSIS = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("sentiment_score", T.DoubleType()),
    T.StructField("sentiment_label", T.StringType()),
    T.StructField("bias_score", T.LongType()),
    T.StructField("biased_sentences", BIASED_SENTENCES),
    T.StructField("propaganda_score", T.LongType()),
    T.StructField("propaganda_sentences", PROPAGANDA_SENTENCES),
    T.StructField("final_score", T.DoubleType()),
    T.StructField("date", T.StringType()),
    T.StructField("email", T.StringType()),
])

# The history table: records in folders of their owner's hash bucket.
HISTORY_TABLE = T.StructType(
    ANALYSIS.fields + [T.StructField("owner_bucket", T.IntegerType())])

# What history files of any age are read with.
HISTORY_FILE = T.StructType(
    ANALYSIS.fields + [T.StructField("username", T.StringType())])

USER_LEXICON_FILE = T.StructType([
    T.StructField("username", T.StringType()),
    T.StructField("bias_terms", STRINGS),
])

FEEDBACK = T.StructType([
    T.StructField("email", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("feedback", T.StringType()),
])

SENTENCE_SCORE = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("score", T.DoubleType()),
])
