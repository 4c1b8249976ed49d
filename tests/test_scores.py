from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from broadsheet.functions import predicates as P
from broadsheet.functions import scores as S


def test_star_value(spark):
    labels = ["1 star", "2 stars", "3 stars", "4 stars", "5 stars", "1 stars", "LABEL_0", None]
    rows = spark.createDataFrame([(x,) for x in labels], "s string").select(
        S.star_value(F.col("s")).alias("v")).collect()
    assert [r.v for r in rows] == [1, 2, 3, 4, 5, 3, 3, 3]


def test_star_label_round_trip(spark):
    rows = spark.range(1, 6).select(S.star_value(S.star_label(F.col("id"))).alias("v")).collect()
    assert [r.v for r in rows] == [1, 2, 3, 4, 5]


@settings(max_examples=10, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(
    st.floats(0, 100), st.floats(-5, 5),
    st.builds(lambda s, n: s / n, st.integers(1, 4000), st.integers(1, 800))), min_size=1))
def test_round_like_python(spark, values):
    values = [v + 0.0 for v in values if abs(v) > 1e-300 or v == 0]
    if not values:
        return
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", S.round_cents(F.col("v")).alias("r"), S.two_decimals(F.col("v")).alias("t")).collect()
    for row in rows:
        assert row.r == round(row.v, 2), row
        if row.v >= 0:
            assert row.t == f"{row.v:.2f}", row


def test_round_ties(spark):
    values = [k / 40 for k in range(0, 400)] + [k / 8 for k in range(0, 800)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", S.round_cents(F.col("v")).alias("r")).collect()
    assert all(row.r == round(row.v, 2) for row in rows)


def test_score_rules(spark):
    cases = [(5.0, 10, 0, 0, "Positive", 100.0), (3.5, 4, 1, 0, "Positive", 50.0),
             (2.5, 4, 2, 1, "Negative", 0.0), (3.0, 10, 1, 1, "Neutral", 40.0),
             (1.0, 5, 5, 5, "Negative", 0.0), (2.51, 1, 0, 0, "Neutral", 37.75)]
    rows = spark.createDataFrame(cases, "m double, n int, b int, p int, l string, f double")
    for row in rows.select("l", "f", S.sentiment_class(F.col("m")).alias("gl"),
                           S.final_score(*map(F.col, "mbpn")).alias("gf")).collect():
        assert row.gl == row.l and abs(row.gf - row.f) < 1e-9


def test_colors(spark):
    rows = spark.createDataFrame([("Positive",), ("Negative",), ("Neutral",), (None,)], "s string")
    assert [r[0] for r in rows.select(S.sentiment_color(F.col("s"))).collect()] == [
        "#28a745", "#dc3545", "#6c757d", "#6c757d"]


def test_predicates(spark):
    def holds(test, values):
        rows = spark.createDataFrame([(v,) for v in values], "v string")
        return [r[0] for r in rows.select(test(F.col("v"))).collect()]

    assert holds(P.is_url, ["http://a.b/c", "a.b/c", "http:///x", "//a.b", "", None]) == [
        True, False, False, False, False, False]
    assert holds(P.is_email, ["a@b.c", "a@b", "a@@b.c", "@b.c", None]) == [
        True, False, False, False, False]
    assert holds(P.has_text, ["x", " \n", "", None]) == [True, False, False, False]


def test_propaganda_rule(spark):
    rows = spark.createDataFrame(
        [("Propaganda", 0.9), ("propaganda", 0.95), ("Propaganda", 0.8999), ("Other", 0.99),
         (None, 1.0)], "l string, s double")
    kept = rows.select(P.is_propaganda(F.col("l"), F.col("s")).alias("k")).collect()
    assert [r.k for r in kept] == [True, True, False, False, False]
