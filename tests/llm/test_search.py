import math
import re
from collections import Counter

import helpers as H

from broadsheet.llm import search

ITEMS = "item_id long, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(H.LOWER))


def brute(docs, items, top=10):
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    many = sum(n > 0 for _, _, n in held)
    total = sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, count, n in held:
            score = 0
            for term in terms(text):
                if count[term]:
                    w = math.floor(1000 * math.log((2 * many + 2) / (2 * df[term] + 1)))
                    m = 25 + 75 * n * many // total
                    score += w * (10**9 * count[term] // (1000 * count[term] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        scores.sort(key=lambda s: s[:3])
        out += [(item_id, k + 1, s[3], -s[0]) for k, s in enumerate(scores[:top])]
    return sorted(out, key=H.key)


NAMES = ("item_id", "rank", "doc_id", "score")
ODD_ITEMS = [(1, None), (2, ""), (3, "A b, word q?"), (3, "A b, word q?"), (4, "zzz not there"),
             (5, "a a a é😀 one TWO"), (None, "x y z"), (6, "word")]


def test_odd_rows(spark):
    items = spark.createDataFrame(ODD_ITEMS, ITEMS).selectExpr("*", "1 AS score", "2 AS _block")
    got = search.rank_documents(H.clashing(spark), items)
    assert H.rows(got, *NAMES) == brute(H.ODD, ODD_ITEMS)


def test_ties_of_copies(spark):
    docs = [(i % 40, "alpha beta") for i in range(90)] + [(100 + i, "gamma") for i in range(30)]
    items = [(1, "beta"), (2, "beta gamma")]
    got = search.rank_documents(spark.createDataFrame(docs, H.DOCS).repartition(6),
                                spark.createDataFrame(items, ITEMS))
    assert H.rows(got, *NAMES) == brute(docs, items)


def test_blocks_and_integers_agree(spark, monkeypatch):
    docs = H.documents(spark)
    items = spark.read.parquet(f"{H.SF}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()],
                 [(r.item_id, r.text) for r in items.collect()])
    assert H.rows(search.rank_documents(docs.repartition(5), items), *NAMES) == want
    for name, value in (("WAITING", 3), ("SCORES", 64), ("SLICE_BYTES", 999), ("EXACT", 0)):
        monkeypatch.setattr(search, name, value)
    assert H.rows(search.rank_documents(docs, items, block_bytes=3000), *NAMES) == want


def test_empty_tables(spark):
    none_docs, none = spark.createDataFrame([], H.DOCS), spark.createDataFrame([], ITEMS)
    items, docs = spark.createDataFrame([(1, "a")], ITEMS), spark.createDataFrame(H.ODD, H.DOCS)
    assert search.rank_documents(none_docs, items).count() == 0
    assert search.rank_documents(docs, none).columns == list(NAMES)
    assert search.rank_documents(docs, none).count() == 0
