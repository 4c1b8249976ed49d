from pyspark.sql import functions as F

from broadsheet.operators import abbreviations as A


def corpus(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)],
                                 "article_id string, content string")


def test_learnt_from_the_corpus(spark):
    texts = ["We met Dr. X today. It was late."] * 9 + ["The day was late again. So be it."] * 9
    docs = corpus(spark, [*texts, None, "", "no. 3. 3. 3. 3. 3. 3."])
    stats = {r.term: (r.before_stop, r.elsewhere) for r in A.full_stop_stats(docs).collect()}
    assert stats["dr"] == (9, 0) and stats["late"] == (9, 9) and stats["3"] == (6, 0)
    known = A.learn_abbreviations(docs, longest=2)
    assert known == ["dr"]
    rows = A.sentence_table_by(docs, ["dr"]).where("article_id = '0'").orderBy("sent_id")
    assert [tuple(r)[1:] for r in rows.collect()] == [
        (0, "We met Dr. X today."), (1, "It was late.")]
    assert A.sentence_table_by(docs, ["dr"]).where("article_id IN ('18', '19')").count() == 0


def test_joined(spark):
    texts = ["Dr. Prof. X.\n Y! Dr.", "(Dr. A) dr! B", "", "Dr.", "x"]
    rows = A.sentence_table_by(corpus(spark, texts), ["dr", "prof", "o'clock"]).collect()
    got = {}
    for r in sorted(rows):
        got.setdefault(int(r.article_id), []).append(r.sentence)
    assert got == {0: ["Dr. Prof. X.", "Y!", "Dr."], 1: ["(Dr. A) dr!", "B"], 3: ["Dr."],
                   4: ["x"]}
    plain = A.sentence_table_by(corpus(spark, texts), []).where("article_id = '0'")
    assert plain.count() == 5


def test_texts_read_once_and_only_distinct_words_stripped(spark):
    docs = corpus(spark, ["We met Dr. X, dr. Y and Zoe"] * 9)
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    counted = docs.withColumn("content", seen.asNondeterministic()("content"))
    assert A.learn_abbreviations(counted, longest=2) == ["dr"] and read.value == 9
    plan = A.full_stop_stats(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan[plan.rindex("Aggregate"):]
