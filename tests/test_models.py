import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from broadsheet.operators import classify, topics
from broadsheet.plans.annotate import annotate_corpus
from broadsheet.sinks.models import load_model, save_model


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for i in range(60):
        red, blue = i % 2 == 0, i % 3 == 0
        words = ["common", f"w{i}"] + ["red", "crimson"] * red + ["blue", "azure"] * blue
        rows.append((i, words, ["always"] + ["red"] * red + ["blue"] * blue))
    return spark.createDataFrame(
        rows, "article_id int, tokens array<string>, techniques array<string>").cache()


def test_train_predict_save_load(spark, labelled, folder):
    model = classify.train_techniques(labelled, max_iter=20)
    assert model.classes == ["always", "blue", "red"]
    assert model.constants == {"always": 1} and set(model.machines) == {"blue", "red"}
    done = classify.predict_techniques(labelled, model)
    assert done.columns == [*labelled.columns, "predicted_techniques"]
    wrong = [r for r in done.collect() if r.predicted_techniques != sorted(r.techniques)]
    assert not wrong
    save_model(spark, model, f"{folder}/m")
    loaded = load_model(spark, f"{folder}/m")
    again = classify.predict_techniques(labelled, loaded)
    assert sorted(again.collect()) == sorted(done.collect())


def test_no_labels(spark, folder):
    rows = spark.createDataFrame([(1, ["a"], [])], "article_id int, tokens array<string>, "
                                                   "techniques array<string>")
    model = classify.train_techniques(rows)
    assert classify.predict_techniques(rows, model).first().predicted_techniques == []
    save_model(spark, model, f"{folder}/m")
    assert load_model(spark, f"{folder}/m").classes == []
    with pytest.raises(FileNotFoundError):
        load_model(spark, f"{folder}/none")


def test_propaganda_model(labelled):
    rows = labelled.select("article_id", "tokens",
                           F.array_contains("techniques", "red").cast("int").alias("label"))
    model = classify.train_propaganda(rows, buckets=1 << 10)
    scored = classify.score_propaganda(rows.withColumnRenamed("label", "truth"), model,
                                       "article_id", "truth").collect()
    assert all((r.label == "Propaganda") == (r.truth == 1) == (r.score > 0.5) for r in scored)


def test_topics(spark):
    points = [(i, Vectors.dense([0.0 + i % 3 * 0.01, 0.0])) for i in range(30)]
    points += [(100 + i, Vectors.dense([9.0, 9.0 + i % 3 * 0.01])) for i in range(20)]
    points += [(999, Vectors.dense([50.0, -50.0]))]
    rows = spark.createDataFrame(points, ["article_id", "features"])
    model = topics.fit_topics(rows, topics=3, smallest=2, outlier_share=0.0)
    placed = topics.assign_topics(rows, model).collect()
    by_id = {r.article_id: r.topic for r in placed}
    assert {by_id[i] for i in range(30)} == {0}
    assert {by_id[100 + i] for i in range(20)} == {1}
    assert by_id[999] == topics.OUTLIER and len(placed) == 51


def test_annotate_corpus(spark):
    rows = [(str(i), f"Number {i} met the Bandwagon in Paris today." if i % 2 else
             f"Transfer news {i} about cats and parties.") for i in range(40)]
    articles = spark.createDataFrame(rows, "article_id string, content string")
    done = annotate_corpus(articles, gazetteer={"Paris": "GPE"}, stop_words=["the", "in"],
                           n_topics=2, svm_iterations=10)
    got = done.articles.collect()
    assert len(got) == 40 and done.model.classes == ["Bandwagon", "Transfer"]
    one = next(r for r in got if r.article_id == "1")
    assert (one.techniques, one.predicted_techniques, one.entities_text, one.indicators_text) == (
        ["Bandwagon"], ["Bandwagon"], "paris (GPE)", "")
    assert one.processed_content == "number 1 met bandwagon paris today"
    assert {r.topic for r in got} <= {r.topic for r in done.topic_info.collect()}
    assert sum(r["count"] for r in done.topic_info.collect()) == 40


def test_topic_vectors_are_weighted_terms(spark):
    from broadsheet.operators import features
    from broadsheet.plans.annotate import topic_vectors
    rows = [(i, [f"word{i}x{k}" for k in range(60)] + ["common"]) for i in range(4)]
    articles = spark.createDataFrame(rows, "article_id long, tokens array<string>")
    got = {r.article_id: r.topic_features for r in topic_vectors(articles).collect()}
    want = {}
    for r in features.tfidf(articles, F.col("tokens")).collect():
        want.setdefault(r.article_id, []).append(r.weight)
    for i, vector in got.items():
        assert sorted(vector.values) == pytest.approx(sorted(want[i]))
    model = topics.fit_topics(topic_vectors(articles), features="topic_features", topics=2,
                              smallest=1, outlier_share=0.0)
    centers = model.clusters.clusterCenters()
    placed = topics.assign_topics(topic_vectors(articles), model, "topic_features").collect()
    for r in placed:
        vector = r.topic_features.toArray()
        assert r.distance == pytest.approx(min(((vector - c) ** 2).sum() for c in centers))


def test_annotation_makes_tokens_once_for_both_models(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        read.add(1)
        return f"Number {i} met the Bandwagon." if i % 2 else f"Transfer news {i} about cats."
    articles = spark.range(40).select(F.col("id").cast("string").alias("article_id"),
                                      text("id").alias("content"))

    def cached():
        return spark.sparkContext._jsc.getPersistentRDDs().size()
    before, seen = cached(), []

    def machine(run=classify.LinearSVC, **settings):
        seen.append(cached() - before)
        return run(**settings)
    monkeypatch.setattr(classify, "LinearSVC", machine)
    done = annotate_corpus(articles, gazetteer={}, stop_words=["the"], n_topics=2,
                           svm_iterations=5)
    assert done.model.classes == ["Bandwagon", "Transfer"] and read.value == 40
    # Only the features are kept while the solver runs.
    assert min(seen) == 1 and cached() == before


def test_annotation_keeps_nothing_in_memory_but_what_the_solver_copies(spark, monkeypatch):
    """Caches are on disk, and labels whose copies have no room train one at a time."""
    words = ["Bandwagon", "Transfer", "Exaggeration", "Scapegoating"]
    rows = [(str(i), f"Number {i} met the {words[i % 4]} in Paris today.") for i in range(60)]
    articles = spark.createDataFrame(rows, "article_id string, content string")
    before = {item.getKey() for item in spark.sparkContext._jsc.getPersistentRDDs().entrySet()}
    in_memory, busy, most = [], [], []

    def levels():
        held = spark.sparkContext._jsc.getPersistentRDDs()
        return [held[key].getStorageLevel().useMemory() for key in held if key not in before]

    class Machine:
        def __init__(self, run=classify.LinearSVC, **settings):
            self.machine = run(**settings)

        def fit(self, data):
            busy.append(1)
            most.append(len(busy))
            in_memory.extend(levels())
            try:
                return self.machine.fit(data)
            finally:
                busy.pop()

    def clusters(run=topics.KMeans, **settings):
        in_memory.extend(levels())
        return run(**settings)
    monkeypatch.setattr(classify, "LinearSVC", Machine)
    monkeypatch.setattr(topics, "KMeans", clusters)
    monkeypatch.setattr(classify, "cache_bytes", lambda session: 1)
    done = annotate_corpus(articles, gazetteer={}, stop_words=["the"], n_topics=2,
                           svm_iterations=5)
    assert sorted(done.model.machines) == sorted(words)
    assert in_memory and not any(in_memory) and max(most) == 1
    assert classify.predict_techniques(
        articles.selectExpr("split(lower(content), '[ .]') AS tokens"), done.model).count() == 60


def test_cache_bytes(spark):
    assert 1 << 20 < classify.cache_bytes(spark) < 1 << 40


def test_tokens_again_from_their_text(spark):
    from broadsheet.operators import features
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(
        ["The cats! of Ärger_1 ties", "", None, "the", "x  y\tz 12"])],
        "article_id int, content string")
    made = features.with_normalized_tokens(rows, ["the"]).withColumn(
        "again", features.split_tokens("processed_content"))
    assert all(r.tokens == r.again for r in made.collect())


def test_both_vocabularies_in_one_pass(spark):
    from broadsheet.operators import features
    texts = [["bb", "bb", "cc", "a"], ["cc", "dd", "aa"], ["dd", "dd", None], [], ["ee", "aa"]]
    rows = spark.createDataFrame([(t, i % 2 == 1) for i, t in enumerate(texts)],
                                 "tokens array<string>, is_train boolean")
    read = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def seen(tokens):
        read.add(1)
        return tokens
    counted = rows.select(seen.asNondeterministic()("tokens").alias("tokens"), "is_train")
    got = features.fit_tfidf_twice(counted, "is_train", "x", "y", size=3)
    # once to count terms; documents are counted without their tokens
    assert read.value == len(texts)
    want = [features.fit_tfidf(rows, output="x", size=3),
            features.fit_tfidf(rows.where("is_train"), output="y", size=3)]
    for a, b in zip(want, got):
        assert a.stages[0].vocabulary == b.stages[0].vocabulary
        assert a.stages[1].getScalingVec() == b.stages[1].getScalingVec()
        assert a.transform(rows).collect() == b.transform(rows).collect()
    none = features.fit_tfidf_twice(rows.where("NOT is_train"), "is_train", "x", "y", size=3)
    assert none[0] is not None and none[1] is None
    held = {rdd.getKey() for rdd in spark.sparkContext._jsc.getPersistentRDDs().entrySet()}
    features.fit_tfidf_twice(rows, "is_train", "x", "y")
    assert held == {r.getKey() for r in spark.sparkContext._jsc.getPersistentRDDs().entrySet()}
