import hashlib
import re

import helpers as H

from broadsheet.llm import decontaminate as D

ITEMS = "item_id long, text string"
COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(H.LOWER))


def plain(docs, items):
    windows = {}
    for item_id, text in items:
        own = words(text)
        size = min(13, len(own))
        for j in range(len(own) - size + 1 if own else 0):
            windows.setdefault(tuple(own[j:j + size]), set()).add(
                "" if item_id is None else str(item_id))
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for j in range(len(own) - size + 1):
                ids = windows.get(tuple(own[j:j + size]))
                if ids:
                    found |= ids
                    hit.update(range(j, j + size))
        out.append((doc_id, len(own), len(hit), len(found),
                    hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out, key=H.key)


BASE = " ".join(f"w{i}" for i in range(40))
TAIL = " w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"
CASES = H.ODD + [(20, BASE), (20, BASE), (21, "x " * 20 + BASE[20:80].upper() + " y" * 3),
                 (None, BASE + " " + BASE), (22, "a b c d e. A-b"), (23, "a " * 300),
                 (24, "ΑΣ ΑΣ. Σ É é É" + TAIL), (25, "É é ασ" + TAIL)]
BENCH = [(1, BASE), (2, BASE[:60]), (10, "a B"), (11, "a " * 15), (None, BASE), (12, None),
         (13, "..."), (14, "ΑΣ Σ É é É" + TAIL[:27]), (15, "c d e a b"), (1, BASE)]


def test_small(spark):
    docs, bench = H.clashing(spark, CASES), H.clashing(spark, BENCH, ITEMS)
    assert H.rows(D.contamination(docs, bench), *COLUMNS) == plain(CASES, BENCH)


def test_documents(spark):
    docs, bench = H.documents(spark), spark.read.parquet(f"{H.SF}/benchmark.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()],
                 [(r.item_id, r.text) for r in bench.collect()])
    assert any(r[5] for r in want)
    assert H.rows(D.contamination(docs, bench), *COLUMNS) == want


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", -1)
    docs = spark.createDataFrame(CASES, H.DOCS)
    assert H.rows(D.contamination(docs, spark.createDataFrame(BENCH, ITEMS)),
                  *COLUMNS) == plain(CASES, BENCH)


def test_empty_tables_and_filter(spark):
    docs, bench = H.clashing(spark, CASES), spark.createDataFrame(BENCH, ITEMS)
    assert D.contamination(docs.limit(0), bench).count() == 0
    assert not D.contamination(docs, bench.limit(0)).where("contaminated").count()
    kept = D.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    bad = sum(r[5] for r in plain(CASES, BENCH))
    assert kept.count() == len(CASES) - bad
