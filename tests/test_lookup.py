"""Lists of any length against text: the filter inside the row, the join, automata."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import entities as E
from broadsheet.operators import lexicon as L
from broadsheet.operators import lookup
from broadsheet.operators.sentences import sentence_table
from broadsheet.operators.techniques import detect_listed_techniques, detect_substring_techniques

TEXTS = [(1, "The big red fox. A fox and the Big Red dog!"), (2, ""), (3, None),
         (4, "red red red big"), (5, "Nothing of it")]


@pytest.fixture
def articles(spark):
    return spark.createDataFrame(TEXTS, "article_id int, content string")


@pytest.fixture(params=["plan", "bits", "shuffle"])
def form(request, monkeypatch):
    """The three ways a list may take, by its size."""
    if request.param != "plan":
        monkeypatch.setattr(lookup, "PLAN_TERMS", -1)
    if request.param == "shuffle":
        monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    return request.param


def plan(frame):
    out = io.StringIO()
    with redirect_stdout(out):
        frame.explain()
    return out.getvalue()


def test_bits_never_miss(spark, monkeypatch):
    monkeypatch.setattr(lookup, "PLAN_TERMS", -1)
    terms = spark.range(5000).select(F.concat(F.lit("t"), "id").alias("term"))
    held = lookup.Lookup.of(terms.union(spark.createDataFrame([(None,)], "term string")))
    assert held.known is None and len(held.longs) <= lookup.MOST_LONGS
    assert terms.where(~held.may_hold(F.col("term"))).count() == 0
    others = spark.range(5000).select(F.concat(F.lit("u"), "id").alias("term"))
    assert others.where(held.may_hold(F.col("term"))).count() < 1000
    # With a bound table more words pass, still none of the list is lost.
    monkeypatch.setattr(lookup, "MOST_LONGS", 16)
    held = lookup.Lookup.of(terms)
    assert len(held.longs) == 16 and terms.where(~held.may_hold(F.col("term"))).count() == 0


def test_gazetteer(spark, articles, form):
    names = spark.createDataFrame(
        [("Big Red", "X"), ("big red", "Y"), ("fox", "Z"), ("the", "T"), ("red red red", "R"),
         ("dog food", "N")], "name string, label string")
    rows = E.gazetteer_entities(articles, names)
    want = [(1, 0, "the", "T"), (1, 1, "big red", "X"), (1, 1, "big red", "Y"), (1, 3, "fox", "Z"),
            (1, 5, "fox", "Z"), (1, 7, "the", "T"), (1, 8, "big red", "X"), (1, 8, "big red", "Y"),
            (4, 0, "red red red", "R")]
    assert sorted(map(tuple, rows.collect())) == want
    above = plan(rows).split("Generate")[0]
    if form != "shuffle":
        assert "hashpartitioning(text" not in above and "BuildLeft" not in above
    none = spark.createDataFrame([], "name string, label string")
    assert E.gazetteer_entities(articles, none).count() == 0


def test_lexicon(spark, articles, form):
    sentences = sentence_table(articles)
    lexicon = spark.createDataFrame([("FOX",), ("fox",), ("it",), (None,)], "term string")
    rows = L.match_lexicon(sentences, lexicon)
    got = sorted((r.article_id, r.sent_id, tuple(r.detected_terms)) for r in rows.collect())
    assert got == [(1, 0, ("fox",)), (1, 1, ("fox",)), (5, 0, ("it",))]
    if form == "plan":
        assert "Exchange" not in plan(rows)
    assert L.match_lexicon(sentences, lexicon.where("term IS NULL")).count() == 0


def test_listed_names(spark, articles, form):
    names = spark.createDataFrame([("big, red",), ("Red Fox",), ("ox",)], "technique string")
    got = sorted(map(tuple, detect_listed_techniques(articles, names).collect()))
    assert got == [(1, "Red Fox"), (1, "big, red")]


@pytest.mark.parametrize("block", [1 << 20, 8, 1])
def test_substrings(spark, articles, block):
    listed = ["ox", "OX", "red d", "ed", "d r", "thing of", "", None, "absent"]
    names = spark.createDataFrame([(n,) for n in listed], "technique string")
    got = detect_substring_techniques(articles, names, block_bytes=block)
    want = sorted((i, n) for i, t in TEXTS for n in listed if n and n.lower() in (t or "").lower())
    assert sorted(map(tuple, got.collect())) == want and len(want) == 7
    assert "Exchange" not in plan(got)
    assert detect_substring_techniques(articles, names.where("false")).count() == 0


def test_names_read_once_and_asked_in_compiled_code(spark, articles, monkeypatch):
    monkeypatch.setattr(lookup, "PLAN_TERMS", -1)
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(name):
        read.add(1)
        return name

    names = spark.createDataFrame([("big red", "X"), ("fox", "Z"), ("red red red big", "R")],
                                  "text string, label string")
    counted = names.withColumn("text", seen.asNondeterministic()("text"))
    phrases, held = E.listed_phrases(articles, counted, 4)
    assert read.value == 3
    found = held.join(phrases, names, "text")
    assert "lambda" not in plan(phrases) and "SortMergeJoin" not in plan(found)
    assert sorted(map(tuple, found.select("article_id", "pos", "text").collect())) == [
        (1, 1, "big red"), (1, 3, "fox"), (1, 5, "fox"), (1, 8, "big red"),
        (4, 0, "red red red big")]


def test_long_list_passes_few_other_phrases(spark, monkeypatch):
    """A list that fills the small bit table still keeps nearly all other phrases in the task."""
    monkeypatch.setattr(lookup, "MOST_LONGS", 16)
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 400)
    names = spark.range(3000).select(F.concat(F.lit("N"), "id").alias("name"), F.lit("X").alias(
        "label")).union(spark.createDataFrame([("w1", "Y"), (None, "Z"), ("n7 w7", "P")],
                                              "name string, label string"))
    articles = spark.range(2000).select(F.col("id").alias("article_id"), F.concat_ws(
        " ", F.lit("w1"), F.concat(F.lit("n"), F.col("id") * 2),
        F.concat(F.lit("w"), "id"), F.lit("w1")).alias("content"))
    low = names.select(F.lower("name").alias("text"), "label")
    phrases, held = E.listed_phrases(articles, low, 2)
    assert not held.small and held.blocks
    found = E.gazetteer_entities(articles, names, longest=2)
    got = sorted(map(tuple, found.collect()))
    want = [(i, p, "w1", "Y") for i in range(2000) for p in (0, 3)]
    want += [(i, 1, f"n{2 * i}", "X") for i in range(1500)] + [(1, 2, "w1", "Y")]
    assert got == sorted(want)
    rows = phrases.count()
    assert len(want) <= rows < len(want) + 1500
    # Names in most places are sent, within the bytes that may be; they are not shuffled.
    monkeypatch.setattr(E, "COMMON_SAMPLE", 1)
    monkeypatch.setattr(E, "COMMON_BYTES", 400)
    sent = {r.text for r in E._common(phrases).collect()}
    assert "w1" in sent and sum(len(t) + 16 for t in sent) <= 800
    found = E.gazetteer_entities(articles, names, longest=2)
    assert sorted(map(tuple, found.collect())) == got
