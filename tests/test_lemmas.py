from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import features as O
from broadsheet.operators import lemmas as M

PAIRS = ([(f"{w}ies", f"{w}y") for w in ("cit", "part", "stor", "lad")]
         + [(f"{w}s", w) for w in ("dog", "cat", "tree", "house", "car")]
         + [(w, w) for w in ("bus", "virus", "status", "red", "blue")]
         + [("went", "go"), ("mice", "mouse")])


def brute(pairs, longest, least, percent, most):
    votes = defaultdict(Counter)
    for term, lemma in pairs:
        for k in range(min(longest, len(term)) + 1):
            stem = term[:len(term) - k]
            votes[term[len(term) - k:]][
                lemma[len(stem):] if lemma.startswith(stem) else None] += 1
    out = {}
    for ending, found in votes.items():
        best = sorted((-n, r) for r, n in found.items() if r is not None)
        if best:
            n, words = -best[0][0], sum(found.values())
            if n >= least and n * most >= len(pairs) and 100 * n >= percent * words:
                out[ending] = (best[0][1], n, words)
    return out


def table(spark, pairs):
    return spark.createDataFrame(pairs, "term string, lemma string")


@pytest.mark.parametrize("bounds", [
    {"longest": 5, "least": 2, "percent": 60, "most": 1000},
    {"longest": 3, "least": 1, "percent": 100, "most": 1000},
    {"longest": 0, "least": 1, "percent": 1, "most": 1000},
    {"longest": 5, "least": 1, "percent": 50, "most": 4}])
def test_rules_equal_brute_force(spark, bounds):
    got = {r.ending: (r.replacement, r.support, r.words)
           for r in M.ending_rules(table(spark, PAIRS), **bounds).collect()}
    assert got == brute(PAIRS, **bounds)


def test_longest_ending_decides(spark):
    rules = M.LemmaRules({"s": "", "ies": "y", "us": "us", "": "", "o'": "\\"})
    words = ["cities", "dogs", "campus", "red", "s", "", "o'", None]
    rows = spark.createDataFrame([(w,) for w in words], "term string")
    got = [r.l for r in rows.select(F.expr(rules.sql("term")).alias("l")).collect()]
    assert got == ["city", "dog", "campus", "red", "", "", "\\", None]
    assert M.LemmaRules({}).sql("term") == "term"


def test_table_before_rules(spark):
    rules = M.LemmaRules.learn(table(spark, PAIRS), least=2)
    lemmas = table(spark, PAIRS + [("went", "a"), (None, "x"), ("x", None), ("", "")])
    terms = spark.createDataFrame(
        [("went", 1), ("went", 2), ("bodies", 3), ("cacti", 4), (None, 5)], "term string, lemma_id int")
    got = {r.lemma_id: r.lemma for r in M.lemmatized(terms, lemmas, rules).collect()}
    assert got == {1: "a", 2: "a", 3: "body", 4: "cacti", 5: None}


def test_empty_table(spark):
    none = table(spark, [])
    assert M.LemmaRules.learn(none).rules == {}
    assert M.corpus_lemmas(none).count() == 0


def test_corpus_lemmas(spark):
    words = table(spark, [(w, "") for w in
                          ("dogs", "dog", "news", "cities", "city", "glass", "dogs", None)])
    assert {r.term: r.lemma for r in M.corpus_lemmas(words).collect()} == {
        "dogs": "dog", "dog": "dog", "news": "news", "cities": "city", "city": "city",
        "glass": "glass"}


def test_normalised_by_rules(spark):
    rules = M.LemmaRules({"ies": "y", "s": ""})
    docs = spark.createDataFrame([(1, "The cities, dogs!"), (2, None)], "article_id int, content string")
    got = O.with_normalized_tokens(docs, ["the"], lemma=rules.sql).collect()
    assert [r.processed_content for r in got] == ["city dog", ""]


def test_counted_terms(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b", None]), (2, []), (3, None)],
                                 "article_id int, t array<string>")
    got = sorted(tuple(r) for r in O.counted_terms(rows, F.col("t"), "article_id").collect())
    assert got == [(1, "a", 1), (1, "b", 2)]
