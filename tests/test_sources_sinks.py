import csv
import datetime
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from broadsheet import constants as C
from broadsheet import schemas
from broadsheet.functions import fields as N
from broadsheet.operators import history as H
from broadsheet.operators.scorers import TermPropaganda, ValenceStars
from broadsheet.plans.article_analysis import analysis_records, score_articles
from broadsheet.sinks import outputs
from broadsheet.sources import corpus, lexicons, techniques
from broadsheet.sources.history import read_history, read_history_files
from broadsheet.streaming.incremental import append_analyses, stream_articles

SCORING = {"bias_terms": C.DEFAULT_BIAS_TERMS, "stars": ValenceStars(("good",), ("bad",)),
           "propaganda": TermPropaganda(("they",))}


def write(path, value):
    with open(path, "w", encoding="utf-8") as file:
        json.dump(value, file, ensure_ascii=False)
    return path


def test_corpus(spark, folder):
    path = write(f"{folder}/c.json", [
        {"Title": "Été.", "meta": {"lang": "fr", "size": {"n": 3}}, "Indicators": ["a", "b"]},
        {"Title": "Two.", "source": "s", "meta": {"lang": "en"}}])
    rows = corpus.read_corpus(spark, path)
    assert set(rows.columns) == {"content", "source", "Indicators", "meta.lang", "meta.size.n"}
    first = rows.filter("content = 'Été.'").first()
    assert first["meta.size.n"] == 3 and first["Indicators"] == ["a", "b"]
    full = corpus.with_missing_columns(rows)
    assert full.schema["article_id"].nullable and "title" in full.columns
    with pytest.raises(ValueError):
        corpus.read_corpus(spark, write(f"{folder}/bad.json", [{"body": "x"}]))


def test_corpus_lines(spark, folder):
    with open(f"{folder}/c.jsonl", "w") as file:
        file.write('{"content": "One."}\n{"content": "Two."}\n')
    assert corpus.read_corpus(spark, f"{folder}/c.jsonl", lines=True).count() == 2


def test_pasted(spark):
    rows = spark.createDataFrame([("  hi \n",)], "body string")
    assert corpus.pasted_articles(rows, "body").first().content == "hi"


def test_techniques(spark, folder):
    path = write(f"{folder}/t.json", list(C.DEFAULT_TECHNIQUES))
    assert techniques.technique_names(spark, path) == list(C.DEFAULT_TECHNIQUES)
    assert len(C.DEFAULT_TECHNIQUES) == 22


def test_user_lexicons_hide_passwords(spark, folder):
    path = write(f"{folder}/u.json", [
        {"username": "a", "password": "x", "bias_terms": ["Vile", "awful"]},
        {"username": "b", "password": "y", "bias_terms": []}])
    rows = lexicons.read_user_lexicons(spark, path)
    assert rows.columns == ["owner", "pos", "term"]
    assert sorted(map(tuple, rows.collect())) == [("a", 0, "Vile"), ("a", 1, "awful")]


OLD = [{"title": "Old", "text": "t", "sentiment_score": -0.07, "sentiment_label": "Negative",
        "bias_score": 1, "biased_sentences": [{"sentence": "s", "detected_terms": ["vile"]}],
        "propaganda_score": 2, "propaganda_sentences": [
            {"sentence": "s1", "detected_techniques": ["A", "B"], "scores": [0.9, 0.6]},
            {"sentence": "s2", "detected_techniques": [], "scores": []}],
        "final_score": 0, "date": "2024-10-17 08:30:00", "username": "eve"}]
NEW = [{"title": "New", "propaganda_sentences": [
    {"sentence": "s", "score": 0.95, "label": "Propaganda"}], "email": "a@b.c",
    "date": "2024-10-18 08:30:00"}, {"text": "bare"}]


def test_old_and_new_history(spark, folder):
    write(f"{folder}/eve_history.json", OLD)
    write(f"{folder}/new_history.json", NEW)
    rows = read_history_files(spark, f"{folder}/*_history.json")
    by_owner = {r.email: r for r in rows.collect()}
    assert set(by_owner) == {"eve", "a@b.c", "guest"}
    assert by_owner["eve"].sentiment_score == -0.07
    pairs = H.technique_rows(rows, "title").collect()
    assert [(r.title, r.pos, r.technique, r.score) for r in pairs] == [
        ("Old", 0, "A", 0.9), ("Old", 0, "B", 0.6)]
    shown = {r.email: r for r in H.with_display_defaults(rows).collect()}
    bare = shown["guest"]
    assert (bare.title, bare.sentiment_score, bare.sentiment_label, bare.bias_score,
            bare.date) == ("Untitled Article", 3.0, "Neutral", 0, "N/A")


def articles(spark):
    rows = [("1", "My title", "Good. They are vile, «été»!", "ann@x.y"),
            ("2", None, "Bad \"quoted\", text.", None)]
    return spark.createDataFrame(rows, "article_id string, title string, content string, "
                                       "email string")


def records(spark, when="2024-10-17 08:30:00"):
    return analysis_records(score_articles(articles(spark), fold=False, **SCORING),
                            F.lit(when).cast("timestamp"))


def test_history_table(spark, folder):
    path = f"{folder}/history"
    assert read_history(spark, path).count() == 0
    outputs.append_history(records(spark), path)
    outputs.append_history(records(spark, "2024-10-18 09:00:00"), path)
    saved = read_history(spark, path)
    assert saved.count() == 4 and saved.schema == schemas.HISTORY_TABLE
    mine = H.history_of(saved, "ann@x.y")
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(owner_bucket" in plan
    assert len(glob.glob(f"{path}/owner_bucket=*")) == len(
        {r.owner_bucket for r in saved.collect()}) <= C.OWNER_BUCKETS
    assert 0 < len(glob.glob(f"{path}/*/run=*/*.parquet")) <= 4
    dates = [r.date for r in H.newest_first(mine).collect()]
    assert dates == ["2024-10-18 09:00:00", "2024-10-17 08:30:00"]
    assert mine.first().biased_sentences[0].detected_terms == ["vile"]


def test_a_batch_saved_again_counts_once(spark, folder):
    path, notes = f"{folder}/history", f"{folder}/feedback"
    entries = spark.createDataFrame([("a@b.c", "nice")], "email string, feedback string")
    for run in ("day/1", "day/1", "day/2", "day/1", None, None):
        outputs.append_history(records(spark), path, run=run)
        outputs.append_feedback(entries, notes, run=run)
    assert read_history(spark, path).count() == 4 * 2
    assert spark.read.schema(schemas.FEEDBACK).json(notes).count() == 4


def test_export(spark, folder):
    path = f"{folder}/export"
    outputs.write_export(records(spark), path)
    rows = (spark.read.option("header", True).option("escape", '"').csv(path)
            .orderBy("Title").collect())
    assert list(rows[0].asDict()) == [
        "Title", "Date", "Analyzed By", "Sentiment Score", "Sentiment Label", "Bias Count",
        "Propaganda Count", "Final Score", "Biased Sentences", "Propaganda Sentences"]
    assert rows[1].Title == "My title"
    nested = json.loads(rows[1]["Biased Sentences"])
    assert nested == [{"sentence": "They are vile, «été»!", "detected_terms": ["vile"]}]
    assert "«été»" in rows[1]["Biased Sentences"]
    names = [r.file_name for r in H.export_rows(records(spark)).orderBy("Title").collect()]
    assert names == ["analysis_Article.csv", "analysis_My_title.csv"]


def test_one_export_file_for_each_analysis(spark, folder):
    path = f"{folder}/files"
    titles = ["My title", "my Title", "a/b: c?", None, "My title", "x" * 300, "My title (2)"]
    rows = records(spark).limit(1).drop("title", "date").crossJoin(spark.createDataFrame(
        [(t, f"2024-10-17 08:30:0{i}") for i, t in enumerate(titles)],
        "title string, date string"))
    for _ in range(2):
        outputs.write_export_files(rows, path)
    names = sorted(name for name in os.listdir(path) if name.endswith(".csv"))
    long = [name for name in names if "xxx" in name]
    assert len(long) == 1 and len(long[0]) < 80
    assert sorted(set(names) - set(long)) == [
        "analysis_My_title (3).csv", "analysis_My_title.csv", "analysis_My_title_(2).csv",
        "analysis_a_b__c_.csv", "analysis_my_Title (2).csv",
        f"analysis_{C.EXPORT_FILE_TITLE}.csv"]
    with open(f"{path}/_SUCCESS") as file:
        assert file.read() == "7"
    with open(f"{path}/analysis_My_title (3).csv", encoding="utf-8", newline="") as file:
        (record,) = csv.DictReader(file)
    assert record["Title"] == "My title" and record["Date"] == "2024-10-17 08:30:04"
    assert list(record)[0] == "Title" and len(record) == 10
    assert "«été»" in record["Biased Sentences"] or record["Biased Sentences"] == "[]"


def test_feedback(spark, folder):
    now = datetime.datetime(2024, 10, 17)
    rows = spark.createDataFrame([("a@b.c", now, "nice"), (None, now, "ok"), ("x", now, "  "),
                                  ("y", now, None)], schemas.FEEDBACK)
    outputs.append_feedback(rows, f"{folder}/f")
    outputs.append_feedback(rows, f"{folder}/f")
    saved = spark.read.schema(schemas.FEEDBACK).json(f"{folder}/f")
    assert {r.timestamp for r in saved.collect()} == {now}
    assert sorted((r.email, r.feedback) for r in saved.collect()) == [
        ("a@b.c", "nice"), ("a@b.c", "nice"), ("guest", "ok"), ("guest", "ok")]


def test_annotated_round_trip(spark, folder):
    rows = spark.createDataFrame([("1", "s", ["a"])], "article_id string, source string, "
                                                      "techniques array<string>")
    outputs.write_annotated(rows, f"{folder}/p", partition_by="source")
    assert spark.read.parquet(f"{folder}/p").first().techniques == ["a"]


def test_report(spark, folder):
    summary = spark.createDataFrame([(4, 2834, "Topic 0: 0_a_b<br>Topic 1: 1_<c>")],
                                    "propaganda_articles long, other_articles long, "
                                    "topics_html string")
    outputs.write_report(spark, summary, f"{folder}/r")
    page = "\n".join(r.value for r in spark.read.text(f"{folder}/r").collect())
    assert "<td>with a technique</td><td>4</td>" in page and "<td>2834</td>" in page
    assert "<li>Topic 0: 0_a_b</li><li>Topic 1: 1_&lt;c&gt;</li>" in page


def test_flat_lists(spark):
    rows = spark.createDataFrame(
        [([("x", "ORG"), ("y", "GPE")], ["p", "q"]), ([], []), (None, None)],
        "e array<struct<text:string,label:string>>, i array<string>")
    flat = rows.select(N.entities_text(F.col("e")), N.list_text(F.col("i"))).collect()
    assert [tuple(r) for r in flat] == [("x (ORG), y (GPE)", "p, q"), ("", ""), ("", "")]


def test_stream_appends_once(spark, folder):
    landed, out, log = f"{folder}/in", f"{folder}/out", f"{folder}/log"
    articles(spark).write.json(landed)
    schema = "article_id string, title string, content string, email string"

    def run():
        append_analyses(stream_articles(spark, landed, schema), out, log,
                        **SCORING).awaitTermination(120)
        return read_history(spark, out).count()

    assert run() == 2 and run() == 2
    articles(spark).write.mode("append").json(landed)
    assert run() == 4
