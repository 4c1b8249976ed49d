import pytest
from pyspark.sql import functions as F

from broadsheet import constants as C
from broadsheet.operators import lexicon as L
from broadsheet.operators.sentences import sentence_table, token_table
from broadsheet.operators.techniques import detect_techniques, flag_propaganda
from broadsheet.sources import lexicons


@pytest.fixture
def sentences(spark):
    rows = [(1, 'He said: "ILLEGAL claims!" Nothing here. A vile, vile regime.', "ann"),
            (2, "Illegally done. Calm.", "bob"), (3, None, "ann")]
    articles = spark.createDataFrame(rows, "article_id int, content string, owner string")
    return sentence_table(articles, "content", "owner")


def found(rows):
    return sorted((r.article_id, r.sent_id, tuple(r.detected_terms)) for r in rows.collect())


WANT = [(1, 0, ("claims", "illegal")), (1, 1, ("regime", "vile"))]


def test_built_in_lists():
    assert len(lexicons.built_in_terms()) == 89
    extended = lexicons.built_in_terms("extended")
    assert len(extended) == 106 and set(C.DEFAULT_BIAS_TERMS) < set(extended)
    assert {t for t in extended if " " in t} == {"everyone knows", "no one believes"}


def test_list_and_table_agree(spark, sentences):
    assert found(L.match_terms(sentences, C.DEFAULT_BIAS_TERMS)) == WANT
    assert found(L.match_lexicon(sentences, lexicons.built_in_lexicon(spark))) == WANT
    assert found(L.match_terms(sentences, [])) == []


def test_table_match_without_broadcast(spark, sentences):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert found(L.match_lexicon(sentences, lexicons.built_in_lexicon(spark))) == WANT
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_owner_lists(spark, sentences):
    lists = spark.createDataFrame([("bob", ["Calm", "calm"]), ("eve", [])],
                                  "username string, bias_terms array<string>")
    own = lexicons.explode_terms(lists, "username", "bias_terms")
    got = L.match_owner_lexicons(sentences, own, ["Nothing"])
    assert found(got) == [(1, 0, ("nothing",)), (2, 1, ("calm",))]
    # An owner with an empty list has no hits; only one without a list has the default.
    owners = lists.select(lists.username.alias("owner"))
    words = found(L.match_owner_lexicons(sentences, own, ["Nothing", "vile", "quiet"], owners))
    free = found(L.match_owner_lexicons(sentences, own, ["Nothing", "vile", "quiet"]))
    assert set(words) <= set(free)


def test_bias_counts(spark):
    rows = spark.createDataFrame([(1, "Vile! Vile and awful. Fine."), (2, "Fine."), (3, None)],
                                 "article_id int, content string")
    counts = {r.article_id: r.bias_score
              for r in L.bias_counts(rows, C.DEFAULT_BIAS_TERMS).collect()}
    assert counts == {1: 2, 2: 0, 3: 0}


def test_token_table_distinct(sentences):
    tokens = token_table(sentences)
    assert tokens.filter("article_id = 1 and sent_id = 1").count() == 3


def test_add(spark):
    have = spark.createDataFrame([("a", "Vile"), ("b", "awful")], "owner string, term string")
    new = spark.createDataFrame([("a", 1, " vile "), ("a", 2, "awful"), ("a", 3, "  "),
                                 ("a", 4, "Awful"), ("c", 5, "x")],
                                "owner string, pos int, term string")
    status = sorted(map(tuple, L.add_terms(have, new).collect()))
    assert status == [("a", "", "blank"), ("a", "awful", "added"), ("a", "vile", "exists"),
                      ("c", "x", "added")]
    assert L.extend_lexicon(have, new).count() == 4


def test_edit_keeps_first_spelling_and_is_idempotent(spark):
    text = "\n  Radical \n\nradical\nvile\nRADICAL\nCrisis\n"
    edits = spark.createDataFrame([("a", text)], "owner string, txt string")
    once = L.edit_lexicon(edits)
    terms = [r.term for r in once.orderBy("pos").collect()]
    assert terms == ["Radical", "vile", "Crisis"]
    again = L.edit_lexicon(once.groupBy("owner").agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]), "\n").alias("txt")))
    assert [r.term for r in again.orderBy("pos").collect()] == terms


def test_reset(spark):
    have = spark.createDataFrame([("a", "x"), ("b", "y")], "owner string, term string")
    done = L.reset_lexicon(have, "a", lexicons.built_in_lexicon(spark))
    assert done.filter("owner = 'a'").count() == 89
    assert done.filter("owner = 'b'").count() == 1


def test_techniques(spark):
    rows = spark.createDataFrame(
        [(1, "BANDWAGON and transferred, repetitive phrasing"), (2, "none"), (3, None)],
        "article_id int, content string")
    done = flag_propaganda(detect_techniques(rows, C.DEFAULT_TECHNIQUES)).collect()
    assert [r.techniques for r in done] == [["Bandwagon", "Transfer"], [], []]
    assert [r.is_propaganda for r in done] == [True, False, False]
    assert detect_techniques(rows, []).first().detected_techniques == []
