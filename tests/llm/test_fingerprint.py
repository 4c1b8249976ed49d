import hashlib

import helpers as H

from broadsheet.llm import fingerprint as X


def likeness(a, b):
    a, b = (H.shingles(t.lower()) for t in (a, b))
    return len(a & b) / len(a | b) if a or b else 1.0


def compare(data, frame):
    order = sorted((d is not None, d or 0, t or "") for d, t in data)
    want = []
    for i, (known, doc_id, text) in enumerate(order):
        after, n = order[(i + 1) % len(order)][2], len(text)
        edited = text[:n - n // 2] + after[:n // 2]
        want.append((doc_id if known else None, n, hashlib.sha256(edited.encode()).hexdigest(),
                     likeness(text, edited), likeness(text, after)))
    got = frame.collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=H.key) == sorted(
        (w[:3] for w in want), key=H.key)
    by_edit = {(r.doc_id, r.edited_sha256): r for r in got}
    errors = []
    for doc_id, _, digest, edited, following in want:
        row = by_edit[doc_id, digest]
        errors += [abs(row.near_edited - edited), abs(row.near_next - following)]
        assert max(errors) < 0.2, (row, edited, following)
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.04
    return got


def test_small(spark):
    got = compare(H.ODD, X.fingerprint_report(H.clashing(spark)))
    same = {r.fingerprint for r in got if r.doc_id == 7}
    assert len(same) == 1 and all(len(f) == X.BINS for f in same)
    assert {r.fingerprint for r in got if r.doc_id in (1, 4)} == {""}


def test_one_document_is_its_own_next(spark):
    compare([(5, "a b c d e f g h")], X.fingerprint_report(
        spark.createDataFrame([(5, "a b c d e f g h")], H.DOCS)))
    assert X.fingerprint_report(spark.createDataFrame([], H.DOCS)).count() == 0


def test_documents_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(X, "ROWS_PER_BUCKET", 7)
    docs = H.documents(spark)
    compare([(r.doc_id, r.text) for r in docs.collect()], X.fingerprint_report(docs))


def test_plan_is_native(spark):
    plan = X.fingerprint_report(H.documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
