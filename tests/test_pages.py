import pandas as pd
from pyspark.sql import functions as F

from broadsheet.sources import pages

HTML = {
    "main": "<p>skip</p><main class=x><h1> Title </h1><p>One &amp; two</p></main><p>skip</p>",
    "two": "<html><p>One <b>bold</b> end</p><div>no</div><p>Two</p></html>",
    "unclosed": "<article><p>One<br><p>Two</p> tail</article> outside",
    "script": "<p>A<script>var t='</p><p>x';</script>B</p><style>p{}</style><!-- <p>c</p> -->",
    "nothing": "<div>no paragraph</div>",
    "entities": "<p>caf&eacute; &copy; &#233; a&nbsp;b</p>",
}
WANT = {"main": "Title One & two", "two": "One bold end Two", "unclosed": "One Two tail",
        "script": "A B", "nothing": "", "entities": "café © é a b"}


def test_page_text(spark):
    rows = spark.createDataFrame(list(HTML.items()), "k string, html string")
    got = {r.k: r.t for r in rows.select("k", pages.page_text("html").alias("t")).collect()}
    assert got == WANT


def test_pattern_form_on_well_formed_pages(spark):
    rows = spark.createDataFrame(list(HTML.items()), "k string, html string")
    got = {r.k: r.t for r in rows.select(
        "k", pages.page_text_by_pattern(F.col("html")).alias("t")).collect()}
    for key in ("main", "two", "script", "nothing"):
        assert got[key] == WANT[key]


def test_page_articles(spark):
    rows = spark.createDataFrame(
        [(1, "http://a.b/c", HTML["two"], 200), (2, "a.b", HTML["two"], 200),
         (3, "http://a.b/d", HTML["two"], 404), (4, "http://a.b/e", HTML["nothing"], 200),
         (5, "http://a.b/f", None, 200), (6, "http://a.b/g", HTML["two"], None)],
        "page_id int, url string, html string, status int")
    got = {r.page_id: r.reason for r in pages.page_articles(rows).collect()}
    assert got == {1: None, 2: "invalid_url", 3: "http_error", 4: "no_content",
                   5: "no_content", 6: "http_error"}
    assert [r.content for r in pages.usable(pages.page_articles(rows)).collect()] == [
        "One bold end Two"]


def test_pages_come_in_short_batches(spark):
    @F.pandas_udf("string")
    def held(html: pd.Series) -> pd.Series:
        return html.map(lambda _: str(len(html)))

    limits = {f"spark.sql.execution.arrow.max{n}PerBatch": v
              for n, v in (("Records", "10000"), ("Bytes", "2147483647"))}
    for name, value in limits.items():
        spark.conf.set(name, value)
    rows = spark.range(2600).coalesce(1).selectExpr(
        "id AS page_id", "'http://a.b/c' AS url", "repeat('x', 9000) AS html")
    sizes = {int(r.content) for r in pages.page_articles(rows, extract=held).collect()}
    assert max(sizes) * 9000 <= 5 << 20
