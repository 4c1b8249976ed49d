"""Owners' lists as a saved table: two edits, additions and a reset, saved and read back."""

import glob

import pytest
from pyspark.sql import functions as F

from broadsheet.operators.lexicon import match_lexicon
from broadsheet.operators.sentences import sentence_table
from broadsheet.sinks import lexicon_store as S
from broadsheet.sources.lexicons import built_in_terms

ROWS = "owner string, seq int, terms array<string>"


@pytest.fixture
def store(spark, folder):
    def change(kind, *rows, run=None):
        frame = spark.createDataFrame(list(rows), ROWS)
        S.save_changes(S.changes_of(frame, kind), folder, run)
        S.refresh_lexicons(spark, folder, frame)
    change.path = folder
    return change


def lists(spark, path):
    rows = S.read_lexicons(spark, path).orderBy("owner", "seq", "pos").collect()
    held = {}
    for row in rows:
        held.setdefault(row.owner, []).append(row.term)
    return held


def test_two_edits_and_a_reset(spark, store):
    assert lists(spark, store.path) == {}
    store("add", ("ann", 1, ["Vile", "vile", " bad ", ""]), ("bob", 1, ["x"]))
    assert lists(spark, store.path) == {"ann": ["Vile", "bad"], "bob": ["x"]}
    store("edit", ("ann", 2, ["one", "Two"]))
    store("add", ("ann", 3, ["TWO", "three"]))
    assert lists(spark, store.path) == {"ann": ["one", "Two", "three"], "bob": ["x"]}
    store("edit", ("ann", 4, []))
    assert lists(spark, store.path) == {"bob": ["x"]}
    store("add", ("ann", 5, ["back"]))
    store("reset", ("bob", 2, None))
    assert lists(spark, store.path) == {"ann": ["back"], "bob": built_in_terms()}
    store("add", ("bob", 3, ["vile", "zzz"]))
    assert lists(spark, store.path)["bob"] == [*built_in_terms(), "zzz"]


def test_a_run_saved_again_counts_once(spark, store):
    for _ in range(3):
        store("add", ("ann", 1, ["a", "b"]), run="r1")
    store("add", ("ann", 2, ["c"]), run="r2")
    assert S.read_changes(spark, store.path).count() == 3
    assert lists(spark, store.path) == {"ann": ["a", "b", "c"]}


def test_only_changed_buckets_are_written(spark, store):
    store("add", *((f"o{i}", 1, ["t"]) for i in range(40)))
    before = {p: p for p in glob.glob(f"{store.path}/current/*/*.parquet")}
    store("edit", ("o7", 2, ["new"]))
    after = set(glob.glob(f"{store.path}/current/*/*.parquet"))
    gone = {p.split("/")[-2] for p in set(before) - after}
    assert len(gone) == 1 and lists(spark, store.path)["o7"] == ["new"]
    assert len(lists(spark, store.path)) == 40
    one = S.read_lexicons(spark, store.path, "o7")
    assert [r.term for r in one.collect()] == ["new"]
    assert "PartitionFilters: [isnotnull(owner_bucket" in \
        one._jdf.queryExecution().executedPlan().toString()


def test_saved_list_finds_terms(spark, store):
    store("edit", ("ann", 1, ["Fox"]))
    articles = spark.createDataFrame([(1, "A fox. A dog.")], "article_id int, content string")
    mine = S.read_lexicons(spark, store.path, "ann").select(F.col("term"))
    assert match_lexicon(sentence_table(articles), mine).first().detected_terms == ["fox"]
