import pytest
from pyspark.sql import functions as F

from broadsheet import constants as C
from broadsheet.functions.predicates import is_propaganda
from broadsheet.operators import lexicon as L
from broadsheet.operators.scorers import (
    ModelScorer,
    TermPropaganda,
    ValenceStars,
    score_batches,
    sentence_scores,
    word_model,
)
from broadsheet.operators.sentences import rejected_articles, sentence_counts, sentence_table
from broadsheet.plans import compare
from broadsheet.plans.article_analysis import (
    analyse_from_tables,
    analysis_records,
    score_articles,
)

STARS = ValenceStars(("good", "great"), ("bad",))
TERMS = TermPropaganda(("they", "enemy"))
SCORING = {"bias_terms": C.DEFAULT_BIAS_TERMS, "stars": STARS, "propaganda": TERMS}
TEXTS = [
    (1, "Good and great. They are vile! Bad, bad news. Café closed."),
    (2, "   "), (3, None), (4, "ß"), (5, "Single sentence without stop"),
    (6, "They say the enemy is stupid and vile. They! Bad."),
]


@pytest.fixture
def articles(spark):
    return spark.createDataFrame(TEXTS, "article_id int, content string")


def test_figures(articles):
    rows = {r.article_id: r for r in score_articles(articles, **SCORING).collect()}
    assert sorted(rows) == [1, 5, 6]
    first = rows[1]
    # stars 5, 3, 2, 3 -> 3.25; one biased, one flagged sentence of four
    assert (first.total_sentences, first.sentiment_score, first.sentiment_label) == (
        4, 3.25, "Neutral")
    assert (first.bias_score, first.propaganda_score) == (1, 1)
    assert first.final_score == pytest.approx(56.25 - 12.5 - 12.5)
    assert first.text.endswith("Cafe closed.")
    assert [(b.sentence, b.detected_terms) for b in first.biased_sentences] == [
        ("They are vile!", ["vile"])]
    assert [(p.sentence, p.label) for p in first.propaganda_sentences] == [
        ("They are vile!", "Propaganda")]
    assert rows[6].biased_sentences[0].detected_terms == ["stupid", "vile"]
    assert rows[6].propaganda_score == 2 and rows[6].final_score == 0.0


def test_rejected(articles):
    assert {r.article_id: r.reason for r in rejected_articles(articles).collect()} == {
        2: "no_text", 3: "no_text", 4: "no_sentences"}
    assert {r.article_id: r.total_sentences for r in sentence_counts(articles).collect()} == {
        1: 4, 2: 0, 3: 0, 4: 1, 5: 1, 6: 3}


def test_partitioning_does_not_matter(articles):
    columns = ["article_id", "sentiment_score", "final_score", "biased_sentences"]
    one = score_articles(articles.coalesce(1), **SCORING).select(columns).collect()
    many = score_articles(articles.repartition(7), **SCORING).select(columns).collect()
    assert sorted(one) == sorted(many)


def test_model_scorer_equals_word_lists(articles):
    model = ModelScorer(word_model(STARS.positive, STARS.negative), batch_size=2)
    by_list = score_articles(articles, **SCORING)
    by_model = score_articles(articles, **{**SCORING, "stars": model})
    columns = ["article_id", "sentiment_score", "final_score"]
    assert sorted(by_list.select(columns).collect()) == sorted(by_model.select(columns).collect())


def test_tables_equal_rows(articles):
    folded = score_articles(articles, fold=False, **SCORING)
    sentences = sentence_table(articles)
    stars, terms = sentence_scores(sentences, STARS), sentence_scores(sentences, TERMS)
    joined = analyse_from_tables(articles, sentences, stars, terms,
                                 L.match_terms(sentences, C.DEFAULT_BIAS_TERMS))
    columns = ["article_id", "sentiment_score", "sentiment_label", "bias_score",
               "propaganda_score", "final_score"]
    assert sorted(joined.select(columns).collect()) == sorted(folded.select(columns).collect())


def test_bounds(spark):
    rows = [(i, " ".join(["They are vile."] * a + ["Good great good."] * b))
            for i, (a, b) in enumerate((a, b) for a in range(4) for b in range(4) if a + b)]
    scored = score_articles(spark.createDataFrame(rows, "article_id int, content string"),
                            **SCORING).collect()
    assert all(0 <= r.final_score <= 100 and r.bias_score <= r.total_sentences for r in scored)
    assert len(scored) == len(rows)


def test_record_has_eleven_fields(articles):
    when = F.lit("2024-10-17 08:30:00").cast("timestamp")
    record = analysis_records(score_articles(articles, **SCORING), when).first()
    assert list(record.asDict()) == [
        "title", "text", "sentiment_score", "sentiment_label", "bias_score",
        "biased_sentences", "propaganda_score", "propaganda_sentences", "final_score",
        "date", "email"]
    assert (record.title, record.date, record.email) == (
        "Article", "2024-10-17 08:30:00", "guest")


def test_compare(spark):
    sizes = {"one": 1, "two": 2, "five": 5, "six": 6}
    rows = [(b, i, "Good." if i % 2 else "Bad.") for b, n in sizes.items() for i in range(n)]
    articles = spark.createDataFrame(rows, "batch_id string, article_id int, content string")
    scored = score_articles(compare.comparable(articles), **SCORING).withColumn(
        "title", F.lit(None).cast("string"))
    table = compare.mark_highest(compare.comparison_table(scored, "batch_id", "article_id"))
    got = table.collect()
    assert {r.batch_id for r in got} == {"two", "five", "six"} and len(got) == 13
    for row in got:
        assert row.title == "Article"
        assert row.is_max_final_score == (row.article_id % 2 == 1)
        assert row.is_max_bias_count  # all tie at zero


def test_refused_batches(spark):
    rows = [(b, i) for b, n in {"one": 1, "two": 2, "six": 6}.items() for i in range(n)]
    articles = spark.createDataFrame(rows, "batch_id string, article_id int")
    got = {r.batch_id: (r.articles, r.reason) for r in compare.refused(articles, high=5).collect()}
    assert got == {"one": (1, "fewer than 2 articles"), "six": (6, "more than 5 articles")}
    assert {r.batch_id for r in compare.refused(articles).collect()} == {"one"}
    assert compare.comparable(articles, high=5).count() == 2


def test_analysis_does_not_shuffle(articles):
    scored = score_articles(articles, **SCORING)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_propaganda_threshold(articles):
    strict = score_articles(articles, threshold=0.95, **SCORING)
    assert {r.article_id: r.propaganda_score for r in strict.collect()} == {1: 0, 5: 0, 6: 1}
    rows = sentence_scores(sentence_table(articles), TERMS)
    assert rows.filter(is_propaganda(F.col("label"), F.col("score"))).count() == 3


def test_listed_techniques(spark):
    from broadsheet.operators.techniques import detect_listed_techniques
    articles = spark.createDataFrame(
        [(1, "Fear, Appeals! and more"), (2, "loaded  LANGUAGE of fear"), (3, None), (4, "")],
        "article_id int, content string")
    names = spark.createDataFrame([("Fear Appeals",), ("Loaded Language",), ("fear",), ("!",),
                                   ("Repetitive Phrasing",), ("fear",)], "technique string")
    got = sorted(map(tuple, detect_listed_techniques(articles, names).collect()))
    assert got == [(1, "Fear Appeals"), (1, "fear"), (2, "Loaded Language"), (2, "fear")]
    assert detect_listed_techniques(articles, names.limit(0)).count() == 0


def test_a_model_sees_like_lengths_and_must_answer_each_sentence():
    sentences = ["ccc", "a", "bb", "", "dddd"]
    seen = []

    def model(batch):
        seen.append(list(batch))
        return [(s, float(len(s))) for s in batch]

    assert score_batches(model, sentences, 2) == [(s, float(len(s))) for s in sentences]
    assert seen == [["", "a"], ["bb", "ccc"], ["dddd"]]
    for wrong in (lambda batch: model(batch)[1:], lambda batch: model(batch) + [("x", 0.0)]):
        with pytest.raises(ValueError):
            score_batches(wrong, sentences, 2)
    assert score_batches(model, [], 2) == []


def test_a_model_with_one_result_too_few_fails_the_task(spark):
    rows = spark.createDataFrame([("1", 0, "one two"), ("1", 1, "three")],
                                 "article_id string, sent_id int, sentence string")
    scorer = ModelScorer(lambda: lambda batch: [("x", 1.0)] * (len(batch) - 1))
    with pytest.raises(Exception, match="results for"):
        sentence_scores(rows, scorer).collect()
