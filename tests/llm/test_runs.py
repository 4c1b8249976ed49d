import hashlib
import random
import re
import zlib

import helpers as H
import numpy as np

from broadsheet.llm import queries, runs


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(words, shortest=24, exponent=3):
    """All (start, length, period): compares the words with themselves at every distance."""
    seen, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i - start >= p:
                seen.setdefault((start, i + p), p)
            i += 1
    return sorted((s, e - s, p) for (s, e), p in seen.items()
                  if e - s >= max(shortest, exponent * p))


def planted(pick):
    few = "abcdefghijklmnopqrstuvwxyz"[:pick.choice([1, 2, 3, 26])]
    words = [pick.choice(few) for _ in range(pick.randint(0, 90))]
    for _ in range(pick.randint(0, 2)):
        unit = [pick.choice("abc") for _ in range(pick.randint(1, 12))]
        at = pick.randint(0, len(words))
        words[at:at] = (unit * 40)[:pick.randint(1, 90)]
    return words


def test_runs_against_brute_force():
    pick = random.Random(11)
    docs = [planted(pick) for _ in range(300)] + [["x"] * 500, list("ab") * 100, []]
    borders = np.cumsum([0, *map(len, docs)])
    numbers = np.array([i * 128 + ord(w) for i, d in enumerate(docs) for w in d])
    got = [[] for _ in docs]
    for doc, *run in runs.find_runs(numbers, borders).tolist():
        got[doc].append(tuple(run))
    assert got == [sorted(brute(d), key=lambda r: (r[0], r[2])) for d in docs]


def test_suffix_array():
    pick = random.Random(2)
    for _ in range(50):
        words = np.array([pick.randint(0, 2) for _ in range(pick.randint(1, 60))])
        sa, isa, lcp = runs.suffix_arrays(words)
        text = words.tolist()
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        assert (isa[sa] == np.arange(len(sa))).all()
        for k in range(1, len(sa)):
            a, b = text[sa[k - 1]:], text[sa[k]:]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == same


def want(doc_id, text):
    words = split(text)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    drop = {i for s, m, p in found for i in range(s + p, s + m)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3),
            1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{m},{p}\n" for s, m, p in sorted(found, key=lambda r: (r[0], r[2])))),
            sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def check(data, frame):
    got = runs.run_digest(runs.collapse_runs(queries.with_planted_periods(frame)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                           "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=H.key) == sorted(
        (want(*r) for r in data), key=H.key)


def test_digest(spark):
    pick = random.Random(3)
    odd = [r for r in H.ODD if r[0] != 10] + [(10, "word " * 300), (20, "é \x85 é " * 30)]
    odd += [(100 + i, " ".join(planted(pick))) for i in range(150)]
    check(odd, H.clashing(spark, odd))
    docs = H.documents(spark).where("length(text) < 4000")
    check([(r.doc_id, r.text) for r in docs.collect()], docs)
    assert runs.collapse_runs(spark.createDataFrame([], H.DOCS)).count() == 0


def test_spans_and_text(spark, monkeypatch):
    monkeypatch.setattr(runs, "SLICE_BYTES", 16)
    monkeypatch.setattr(runs, "TESTS", 5)
    frame = spark.createDataFrame([(1, "go " + "la li " * 20 + "\n end"), (2, None)], H.DOCS)
    one, two = runs.collapse_runs(frame).orderBy("doc_id").collect()
    assert [tuple(r) for r in one.runs] == [(1, 40, 2)] and one.collapsed == "go la li end"
    assert two.runs == [] and two.collapsed == "" and two.n_words == 0
