"""Plain versions of the contracts, and small tables that hold every odd case."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"

ODD = [
    (None, None), (None, "q r s"), (1, ""), (2, "A b"), (3, "a  B\t"), (4, " \n "),
    (7, "x y z u v w"), (7, "x y z u v w"), (8, "é😀 a b c d e f g h"),
    (9, "one two three four five six seven eight nine ten"), (10, "word " * 4000),
    (11, "z" * 30000), (12, "<|endoftext|> ▁ <s> \x00 ​"),
]


def key(row):
    return tuple(str(v) for v in row)


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=key)


def clashing(spark, data=None, schema=DOCS):
    """The rows with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F
    frame = spark.createDataFrame(ODD if data is None else data, schema)
    for name in ("doc", "bucket", "spans", "score", "words", "class", "_text", "pii", "n"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words \
        else frozenset()


def documents(spark, folder=SF):
    return spark.read.parquet(f"{folder}/documents.parquet")
