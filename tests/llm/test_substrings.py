import hashlib
import random
import re
from collections import Counter

import helpers as H

from broadsheet.llm import substrings as X

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def plain(docs):
    texts = [(d, (t or "").encode()) for d, t in docs]
    count = Counter(b[p:p + 200] for _, b in texts for p in range(len(b) - 199))
    out = []
    for doc_id, data in texts:
        mark, last = bytearray(len(data)), 0
        for p in range(len(data) - 199):
            if count[data[p:p + 200]] > 1:
                start = max(p, last)
                mark[start:p + 200] = b"\1" * (p + 200 - start)
                last = p + 200
        rest = bytes(x for x, m in zip(data, mark) if not m)
        out.append((doc_id, len(data), sum(mark), len(re.findall(b"\1+", bytes(mark))),
                    hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=H.key)


def cases():
    pick = random.Random(3)
    text = lambda n, letters: "".join(pick.choice(letters) for _ in range(n))
    shared, short = text(150, "abcé d"), text(120, "abcé d")
    yield from H.ODD[:10]
    yield from [(20, "a" * 500), (21, text(300, "xyz")), (22, text(50, "kl") + shared + text(90, "mn")),
                (23, text(77, "op") + shared + text(130, "qr") + shared), (24, short[:90] + short),
                (25, "same " * 100), (25, "same " * 100), (None, "same " * 100),
                (26, "x" + "same " * 100)]
    for n in (199, 200, 201, 250, 331, 332, 333, 400, 700):
        inner = text(n, "abcdefgh")
        for k in range(3):
            yield (n * 10 + k, text(pick.randint(0, 300), "ijklmn") + inner
                   + text(pick.randint(0, 300), "opqrst"))


def test_cover_takes_every_difference():
    assert {(a - b) % X.PERIOD for a in X.COVER for b in X.COVER} == set(range(X.PERIOD))


def test_small(spark):
    data = list(cases())
    assert H.rows(X.substring_dedup(H.clashing(spark, data)), *COLUMNS) == plain(data)
    assert X.substring_dedup(spark.createDataFrame([], H.DOCS)).count() == 0


def test_documents_in_small_pieces(spark, monkeypatch):
    # Executors read the module anew, so only the driver's choices can be changed here.
    monkeypatch.setattr(X, "BROADCAST_ROWS", -1)
    docs = H.documents(spark)
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert any(r[2] for r in want)
    assert H.rows(X.substring_dedup(docs), *COLUMNS) == want


def test_packed_entries_round_trip():
    import numpy as np
    docs = np.array([5, 5, 5, -9, 7, 7], np.int64)
    places = np.array([3, 900, 70000, 0, 1, 2], np.uint32)
    d, p = X._unpack(*X._pack(docs, places))
    assert d.tolist() == docs.tolist() and p.tolist() == places.tolist()
    assert X._unsteps(X._steps(places[:3])).tolist() == [3, 900, 70000]


def test_few_rows_of_many_bytes_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(X, "BROADCAST_BYTES", 0, raising=False)
    frames, join = [], type(spark.range(0)).join
    monkeypatch.setattr(type(spark.range(0)), "join", lambda self, *a, **b: frames.append(
        out := join(self, *a, **b)) or out)
    data = list(cases())
    assert H.rows(X.substring_dedup(H.clashing(spark, data)), *COLUMNS) == plain(data)
    grow = [f for f in frames if {"ranks", "spans"} & set(f.columns)
            and f.columns != ["doc", "spans"]]
    plans = [f._jdf.queryExecution().executedPlan().toString() for f in grow]
    assert [re.search(r"\w+Join", p).group() for p in plans] == ["SortMergeJoin"] * 2
