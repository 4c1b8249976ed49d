import html
import re

import helpers as H

from broadsheet.llm import pages as X

PAGES = "page_id long, url string, html string"


def plain(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    parts = re.split(r"</?(?:p|h1)>", inner)
    lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts)
    return "\n".join(line for line in lines if line)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{H.SF}/pages.parquet")
    want = sorted(((r.page_id, r.url, plain(r.html)) for r in pages.collect()), key=H.key)
    assert H.rows(X.extract_pages(pages), "page_id", "url", "text") == want


def test_odd_markup():
    page = """<html><body><header><h1>Site</h1></header><nav>menu</nav>
      <div class="cookie-notice">x</div><div class="content-with-sidebar"><div id="main">
      <h1>T &amp; <i>i</i>t</h1><p>a  b<br>c<ul><li>1<li>2</ul><table><tr><td>x<td>y</table>
      <script>if(a<b)</script>tail<!-- no <p>no --></div><div class=sidebar>s</div></div>
      <section id="comments"><article class="comment">c</article></section><form>f</form>
      <div hidden>h</div><div style="display: none">d</div><footer>z"""
    assert X.main_text(page).split("\n") == ["T & it", "a b c", "1", "2", "x", "y", "tail"]
    assert X.main_text(None) == X.main_text("") == X.main_text("<nav>a</nav>") == ""
    assert X.main_text("just text") == "just text"
    assert X.main_text("<p>cut <b") == "cut <b"
    assert X.main_text("<article><header><h1>H</h1></header><p>x</article>") == "H\nx"
    assert len(X.main_text("<p>" + "word " * 100_000)) == 499_999
    assert X.main_text("<div>" * 3000 + "deep") == "deep"


def test_repeated_branches_go(spark):
    rows = [(i, f"http://A.b/{i}", f"<body><div class=top>Welcome</div><div class=c><p>Story {i} "
             f"at length {i * 7}</p><p>More {i}</p></div><div class=bot>Rights</div></body>")
            for i in range(12)]
    rows += [(90, "c.d/x", "<p>alone</p>"), (91, None, ""), (92, "", None), (92, "", None)]
    got = {r.page_id: r for r in X.extract_pages(H.clashing(spark, rows, PAGES)).collect()}
    assert got[5].text == "Story 5 at length 35\nMore 5" and got[5].n_chars == len(got[5].text)
    assert got[90].text == "alone" and got[91].text == got[92].text == ""
    assert X.extract_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_equal_pages_keep_their_text(spark):
    rows = [(i, "http://x.y/1", "<body><div><p>all the same</p></div></body>") for i in range(9)]
    assert {r.text for r in X.extract_pages(spark.createDataFrame(rows, PAGES)).collect()} == {
        "all the same"}


def texts(spark, bodies, host="h.i"):
    rows = [(i, f"http://{host}/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    return [r.text.split("\n") for r in X.extract_pages(
        spark.createDataFrame(rows, PAGES)).orderBy("page_id").collect()]


def words(i):
    return " ".join(f"w{i}x{k}" for k in range(20))


def test_repeats_inside_an_article_go(spark):
    got = texts(spark, [
        f"<article><h1>Title {i}</h1><p>{words(i)}</p><p>More of {i}</p><div class=box>Our author "
        "writes here</div></article>" for i in range(10)])
    assert got == [[f"Title {i}", words(i), f"More of {i}"] for i in range(10)]


def test_copies_are_no_template(spark):
    for element in ("article", "div"):
        for story in ([words("s")], [words("s"), words("t"), "The end"]):
            made = [story] * 9 + [[words("u"), "Other"]]
            got = texts(spark, [f"<div class=date>Day {i}</div><{element}><h1>T</h1>" + "".join(
                f"<p>{t}</p>" for t in part) + f"</{element}>" for i, part in enumerate(made)])
            assert all(set(part) <= set(g) for part, g in zip(made, got))


def test_fixed_template_with_own_texts(spark):
    parts = lambda i: [f"{words(i)} part {k}" for k in range(14)]
    got = texts(spark, ["<div class=menubox>Same on all</div><div class=story>" + "".join(
        f"<p class=c{chr(97 + k)}>{t}</p>" for k, t in enumerate(parts(i))) + "</div>"
        for i in range(12)])
    assert got == [parts(i) for i in range(12)]
