import hashlib
import re

import helpers as H

from broadsheet.llm import pii

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def plain(doc_id, text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))
                    or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            found.append((m.start(), rank, kind, m.end()))
    found.sort()
    text = ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)
    return (doc_id, *(sum(f[2] == k for f in found) for k, _ in PATTERNS),
            hashlib.sha256(text.encode()).hexdigest())


COLUMNS = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
CASES = H.ODD + list(enumerate([
    "a@b.c@d.e", "a@b.c_x@d.e é@f.g", "1.2.3.4.5.6.7.8 999.1.1.1 007.0.0.1",
    "4111 1111 1111 1111 x 4111-1111-1111-1112", "+1 (555) 123-4567- +49.30.123456789012345",
    "😀 mail a@b.co 😀 1.1.1.1", "9" * 3000, "a" * 5000 + "@", "x@y" + ".z" * 9000,
    "1 2 3 " * 3000, "a@b-.c..d a@b..c 1.2.3 +1-+2-345678901", "1.2.3.4 " * 2000], 100))


def test_base_spans(spark):
    want = sorted((plain(*r) for r in CASES), key=H.key)
    assert H.rows(pii.pii_digest(H.clashing(spark, CASES)), *COLUMNS) == want


def test_documents(spark):
    docs = H.documents(spark)
    want = sorted((plain(r.doc_id, r.text) for r in docs.collect()), key=H.key)
    assert H.rows(pii.pii_digest(docs), *COLUMNS) == want


def test_added_kinds_and_context(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00.", "iban DE88 3704 0044 0532 0130 00.",
             "my ssn is 123-45-6789", "123-45-6789", "write to a@b.co", "a@b.co"]
    got = {r.doc_id: (r.spans, r.scores) for r in pii.pii_digest(spark.createDataFrame(
        list(enumerate(texts)), H.DOCS)).collect()}
    assert got[0][0] == "iban:5:32" and got[1][0] == "" and got[2][0] == "ssn:10:21"
    assert got[3][0] == "" and got[4][1] == "1.0" and got[5][1] == "0.7"


def test_redaction(spark):
    data = [(1, "x a@b.co, 1.1.1.1!"), (2, None), (3, "plain"), (4, "+1.2.3.4567890 z")]
    docs = H.clashing(spark, data)
    done = pii.redact(docs)
    assert done.columns == docs.columns
    assert {r.doc_id: r.text for r in done.collect()} == {
        1: "x [EMAIL], [IP]!", 2: None, 3: "plain", 4: "[PHONE] z"}


def test_empty(spark):
    assert pii.pii_digest(spark.createDataFrame([], H.DOCS)).count() == 0
