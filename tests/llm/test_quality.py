import zlib

import helpers as H
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from broadsheet.llm import quality as Q

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = Q.quality_report(H.documents(spark, folder), labels).collect()
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in known]
    assert sum(r.predicted == known[r.doc_id] for r in held) / len(held) > 0.95


def test_held_out_labels_have_no_say(spark):
    docs, labels = H.documents(spark), spark.read.parquet(f"{H.SF}/labels.parquet")
    turned = labels.selectExpr(
        "doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 1 - quality "
        "ELSE quality END AS quality")
    columns = ("doc_id", "score")
    assert H.rows(Q.quality_report(docs, labels), *columns) == H.rows(
        Q.quality_report(docs, turned), *columns)


def test_odd_rows(spark):
    docs = H.clashing(spark)
    labels = spark.createDataFrame(
        [(9, 1, 0), (9, 0, 0), (7, 1, 0), (None, 1, 1), (99, 1, None), (3, None, 0), (2, 0, 0)],
        LABELS)
    for some in (labels, labels.limit(0)):
        got = Q.quality_report(docs, some).collect()
        assert len(got) == len(H.ODD) and all(0 <= r.score <= 1 for r in got)
        assert Q.keep_good(docs, some).columns == docs.columns
    assert Q.keep_good(docs, labels.limit(0)).count() == len(H.ODD)
    assert Q.quality_report(docs.limit(0), labels).count() == 0


def test_votes_against_brute_force(spark):
    """Scores from the vectors by plain loops, ties by the order of the sample."""
    docs, labels = H.documents(spark), spark.read.parquet(f"{H.SF}/labels.parquet")
    model = Q.train(docs, labels)
    texts = pa.array([r.text for r in docs.orderBy("doc_id").collect()] + ["", None])
    rows = Q.features(texts)
    held = (rows[:-2] > 0).sum(axis=0)
    assert np.allclose(model.idf, np.log((1 + 200) / (1 + held)) + 1)
    got = model.score(rows)
    many = min(Q.NEIGHBOURS, len(model.labels))
    for row, score in zip(rows, got):
        latent = (row * model.idf) @ model.directions
        size = np.sqrt((latent ** 2).sum())
        latent = latent / size if size else latent * 0
        near = sorted(((-float(v @ latent), i) for i, v in enumerate(model.vectors)))[:many]
        weights = [max(0.0, min(1.0, -c)) ** Q.POWER + 1e-9 for c, _ in near]
        want = sum(w * model.labels[i] for w, (_, i) in zip(weights, near)) / sum(weights)
        assert abs(score - want) < 1e-3
    assert got[-1] == got[-2] and abs(got[-1] - np.mean(model.labels[:many])) < 1e-6


def test_nearest_takes_the_first_of_equals():
    pick = np.random.default_rng(1)
    values = pick.integers(0, 4, (50, 30)).astype(float)
    want = [sorted(sorted(range(30), key=lambda i: (-row[i], i))[:7]) for row in values]
    assert Q.nearest(values, 7).tolist() == want
    assert Q.nearest(values, 30).tolist() == [list(range(30))] * 50


def test_labels_of_absent_documents_take_no_place(spark, monkeypatch):
    docs, labels = H.documents(spark), spark.read.parquet(f"{H.SF}/labels.parquet")
    monkeypatch.setattr(Q, "SAMPLE", 20)
    absent = spark.range(10**6, 10**6 + 3000).selectExpr(
        "id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    both = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).union(absent)
    a, b = Q.train(docs, labels), Q.train(docs, both)
    assert len(a.labels) == len(b.labels) and np.allclose(a.vectors, b.vectors)
