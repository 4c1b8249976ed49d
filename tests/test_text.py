import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from broadsheet.functions import text as X

QUIET = settings(max_examples=12, deadline=None,
                 suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "s string").select(column).first()[0]


def folded(text):
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


def test_fold_every_letter(spark):
    codes = [c for c in range(0x80, 0x30000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join("a" + chr(c) for c in codes[i:i + 200])
             for i in range(0, len(codes), 200)]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select(
        "s", X.ascii_fold(F.col("s")).alias("f")).collect()
    assert all(row.f == folded(row.s) for row in rows)


@QUIET
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"])), min_size=1))
def test_fold_is_nfkd_and_idempotent(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "s string").withColumn(
        "f", X.ascii_fold(F.col("s"))).withColumn("g", X.ascii_fold(F.col("f"))).collect()
    for row in rows:
        assert row.f == folded(row.s) == row.g


def test_has_folded_text(spark):
    for text, want in (("", False), (" \n", False), ("ß", False), ("…", True),
                       ("ß é", True), ("a", True), (" ", False)):
        assert one(spark, X.has_folded_text(F.col("s")), text) is want, repr(text)


def test_sentences(spark):
    split = lambda text: one(spark, X.sentences_of(F.col("s")), text)
    assert split("  One. Two!\n\nThree?  four ") == ["One.", "Two!", "Three?", "four"]
    assert split("No stop here") == ["No stop here"]
    assert split("v1.2 is out... Now!") == ["v1.2 is out...", "Now!"]
    assert split(" \n\t ") == [] and split("") == []


def test_tokens(spark):
    assert one(spark, X.tokens_of(F.col("s")), "L'Été, été_2 'Vile'! vile") == [
        "l", "été", "été_2", "vile", "vile"]
    assert one(spark, X.token_set(F.col("s")), "A b a B") == ["a", "b"]


def test_normalized_tokens(spark):
    words = one(spark, X.normalized_tokens("s", ["the", "is"]),
                "The classes, the parties; this bus is glass. Cats gas")
    assert words == ["class", "party", "this", "bus", "glass", "cat", "gas"]
    assert one(spark, X.normalized_tokens("s", []), None) == []


def test_word_groups(spark):
    runs = spark.createDataFrame([(["a", "b", "c"],), ([],)], "t array<string>").select(
        X.word_groups(F.col("t"), 2).alias("r")).collect()
    assert sorted((r.pos, r.n, r.text) for r in runs[0].r) == [
        (0, 1, "a"), (0, 2, "a b"), (1, 1, "b"), (1, 2, "b c"), (2, 1, "c")]
    assert runs[1].r == []


def test_sql_list_quotes(spark):
    terms = ["it's", "back\\slash", "plain"]
    row = spark.createDataFrame([(terms + ["other"],)], "t array<string>").select(
        F.expr(X.kept_sql("t", terms)).alias("k"),
        F.expr(X.dropped_sql("t", terms)).alias("d"),
        F.expr(X.kept_sql("t", [])).alias("none"),
        F.expr(X.dropped_sql("t", [])).alias("all")).first()
    assert row.k == terms and row.d == ["other"]
    assert row.none == [] and row["all"] == terms + ["other"]
