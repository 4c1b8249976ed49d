import math
from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from broadsheet import constants as C
from broadsheet.catalog import feature_queries
from broadsheet.operators import entities as E
from broadsheet.operators import features as O
from broadsheet.operators import graph, metrics, summary, topics

DOCS = [(1, "red red blue a"), (2, "blue green"), (3, "green green green blue"), (4, "")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "article_id int, content string")


def brute(size):
    tokens = {i: [w for w in text.split() if len(w) >= 2] for i, text in DOCS}
    total, df = Counter(), Counter()
    for words in tokens.values():
        total.update(words)
        df.update(set(words))
    vocab = sorted(total, key=lambda t: (-total[t], t))[:size]
    out = {}
    for i, words in tokens.items():
        raw = {t: words.count(t) * (math.log((1 + len(DOCS)) / (1 + df[t])) + 1)
               for t in vocab if t in words}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out.update({(i, t): x / norm for t, x in raw.items()})
    return out, total, df, vocab


@pytest.mark.parametrize("size", [2, 5000])
def test_tfidf(docs, size):
    got = {(r.article_id, r.term): r.weight
           for r in O.tfidf(docs, O.feature_terms("content"), size).collect()}
    want = brute(size)[0]
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_vectors_equal_tall_rows(docs):
    listed = docs.withColumn("tokens", O.feature_terms("content"))
    model = O.fit_tfidf(listed, size=5000)
    want, _, _, vocab = brute(5000)
    for row in model.transform(listed).select(
            "article_id", vector_to_array("features").alias("v")).collect():
        for term, weight in zip(vocab, row.v):
            assert abs(weight - want.get((row.article_id, term), 0.0)) < 1e-12


def test_term_stats(docs):
    _, total, df, _ = brute(1)
    stats = O.term_stats(docs, O.feature_terms("content"))
    assert {r.term: (r.term_frequency, r.document_frequency) for r in stats.collect()} == {
        t: (total[t], df[t]) for t in total}


def test_empty_vocabulary(spark):
    none = spark.createDataFrame([(1, [])], "article_id int, tokens array<string>")
    assert O.fit_tfidf(none) is None


def test_lemma_dictionary(spark):
    tokens = spark.createDataFrame([(1, "went"), (1, "dog")], "article_id int, term string")
    lemmas = spark.createDataFrame([("went", "go")], "term string, lemma string")
    assert sorted(r.term for r in O.lemmatize(tokens, lemmas).collect()) == ["dog", "go"]


def test_labels(spark):
    rows = spark.createDataFrame([(1, ["b", "a"]), (2, []), (3, ["c"])],
                                 "article_id int, techniques array<string>")
    classes = O.label_names(rows)
    assert classes == ["a", "b", "c"]
    flags = rows.select(O.binarize(F.col("techniques"), classes).alias("f"))
    assert [r.f for r in flags.collect()] == [[1, 1, 0], [0, 0, 0], [0, 0, 1]]
    back = flags.select(O.labels_of(F.col("f"), classes).alias("l")).collect()
    assert [r.l for r in back] == [["a", "b"], [], ["c"]]


def test_split_is_stable(spark):
    ids = spark.range(5000)
    part = {r.id for r in ids.filter(O.is_test_row(F.col("id"))).collect()}
    again = {r.id for r in ids.repartition(7).filter(O.is_test_row(F.col("id"))).collect()}
    assert part == again and 0.17 < len(part) / 5000 < 0.23


JUDGED = [([], []), (["a"], ["a"]), (["a", "b"], ["a"]), (["b"], ["a", "c"]), (["d"], [])]


def test_metrics(spark):
    judged = spark.createDataFrame(JUDGED, "truth array<string>, pred array<string>")
    row = metrics.multilabel_metrics(judged, 4).first()
    assert row.subset_accuracy == pytest.approx(2 / 5)
    assert row.hamming_loss == pytest.approx(5 / 20)
    report = {r.label: r for r in metrics.classification_report(judged, list("abcd")).collect()}
    a, micro = report["a"], report["micro avg"]
    assert (a.precision, a.recall, a.support) == (pytest.approx(2 / 3), 1.0, 2)
    assert report["c"].precision == 0.0 and report["d"].recall == 0.0
    assert (micro.precision, micro.recall) == (pytest.approx(2 / 4), pytest.approx(2 / 5))
    assert report["macro avg"].f1 == pytest.approx(0.8 / 4)
    assert report["weighted avg"].recall == pytest.approx(2 / 5)
    samples = report["samples avg"]
    assert samples.precision == pytest.approx((1 + 1) / 5)
    assert samples.recall == pytest.approx((1 + 0.5) / 5)
    assert samples.f1 == pytest.approx((1 + 2 / 3) / 5)


def test_topics_by_class(spark):
    words = {0: "x x x y z", 1: "y y w", -1: "z"}
    tokens = spark.createDataFrame([(t, w) for t, text in words.items() for w in text.split()],
                                   "topic int, term string")
    total = Counter(w for text in words.values() for w in text.split())
    mean = sum(total.values()) / len(words)
    got = {(r.topic, r.term): r.score for r in topics.class_tfidf(tokens).collect()}
    for topic, text in words.items():
        for term, n in Counter(text.split()).items():
            assert got[topic, term] == pytest.approx(n * math.log(1 + mean / total[term]))
    assigned = spark.createDataFrame([(0,), (0,), (1,), (-1,)], "topic int")
    info = {r.topic: (r["count"], r.name) for r in topics.topic_info(assigned, tokens, 2).collect()}
    assert info == {0: (2, "0_x_z"), 1: (1, "1_w_y"), -1: (1, "-1_z")}
    flagged = spark.createDataFrame([(True,), (False,), (None,)], "is_propaganda boolean")
    row = summary.report_summary(flagged, topics.topic_info(assigned, tokens, 2)).first()
    assert (row.propaganda_articles, row.other_articles) == (1, 2)
    assert row.topics_html == "Topic -1: -1_z<br>Topic 0: 0_x_z<br>Topic 1: 1_w_y"


def test_report_without_topics(spark):
    flagged = spark.createDataFrame([], "is_propaganda boolean")
    info = spark.createDataFrame([], "topic int, count long, name string")
    row = summary.report_summary(flagged, info).first()
    assert (row.propaganda_articles, row.other_articles) == (0, 0)
    assert row.topics_html == C.NO_TOPICS_TEXT


def test_renumber():
    assert topics.renumber_by_size({0: 3, 1: 9, 2: 1, 3: 9}, 2) == {0: 2, 1: 0, 2: -1, 3: 1}


def test_entities(spark):
    rows = spark.createDataFrame(
        [(1, "The New York mayor met Paris, new york. Mail a.b@c.de, 12.5% of $3,000 on "
             "2024-10-17 at https://x.y/z 1234567"), (2, None)],
        "article_id int, content string")
    names = {"New York": "GPE", "Paris": "GPE", "york": "PERSON"}
    table = spark.createDataFrame(list(names.items()), "name string, label string")
    want = [(1, "new york", "GPE"), (2, "york", "PERSON"), (5, "paris", "GPE"),
            (6, "new york", "GPE"), (7, "york", "PERSON")]
    found = E.gazetteer_entities(rows, table).orderBy("pos").collect()
    assert [(r.pos, r.text, r.label) for r in found] == want
    inline = {r.article_id: r.entities for r in E.inline_entities(rows, names).collect()}
    assert [tuple(e) for e in inline[1]] == [w[1:] for w in want] and inline[2] == []
    lists = E.entity_lists(E.gazetteer_entities(rows, table), "pos").first()
    assert [tuple(e) for e in lists.entities] == [w[1:] for w in want]
    rules = {(r.label, r.text) for r in E.pattern_entities(rows).collect()}
    assert rules == {("EMAIL", "a.b@c.de"), ("PERCENT", "12.5%"), ("MONEY", "$3,000"),
                     ("DATE", "2024-10-17"), ("URL", "https://x.y/z"),
                     ("LONG_NUMBER", "1234567")}


def test_graph(spark):
    rows = spark.createDataFrame([("s", 1), ("s", 1), ("s", 2), (None, 3)],
                                 "source string, article_id int")
    nodes = sorted(map(tuple, graph.source_nodes(rows).collect()))
    assert nodes == [("1", "article"), ("2", "article"), ("3", "article"),
                     ("Unknown", "source"), ("s", "source")]
    assert sorted(map(tuple, graph.source_edges(rows).collect())) == [
        ("1", "s"), ("2", "s"), ("3", "Unknown")]
    bare = rows.drop("source")
    assert {r.dst for r in graph.source_edges(bare).collect()} == {"Unknown"}


def test_no_article_is_shuffled_for_its_topic(spark, folder, capsys):
    spark.createDataFrame([(i, "red blue", "en" if i else None) for i in range(9)],
                          "doc_id long, text string, lang string").write.parquet(
                              f"{folder}/documents.parquet")
    joined = feature_queries.by_language(spark, folder)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        joined.explain()
        assert {(r.article_id, r.topic) for r in joined.collect()} == {
            (i, 0) for i in range(1, 9)}
    finally:
        spark.conf.set(threshold, before)
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
