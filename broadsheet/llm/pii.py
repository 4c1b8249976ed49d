"""Personal data: patterns propose spans, checksums confirm, context words score.

Everything is a Column expression inside the document's own row: no shuffle, no
Python, and no group that could be hot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds, written so that no input makes
# them backtrack (a run of local-part letters or digits is entered once only).
LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Added kinds.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CONTEXT_CHARS = 40
CHUNK = 256


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """True when the digits of ``value`` pass the Luhn check."""
    backwards = F.reverse(digits(value))

    def add(total, i):
        digit = F.substring(backwards, i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)
    return F.aggregate(F.sequence(F.lit(1), F.length(backwards)), F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """True when an account number without spaces leaves 1 modulo 97."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(rest, i):
        letter = F.substring(moved, i, F.lit(1))
        return F.when(letter.rlike("[0-9]"), (rest * 10 + letter.cast("int")) % 97).otherwise(
            (rest * 100 + F.ascii(letter) - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def between(low: int, high: int):
    return lambda value: F.length(digits(value)).between(low, high)


@dataclass(frozen=True)
class Kind:
    """``hint`` is a cheap test that a text may hold the kind; ``base`` the score
    of a confirmed span, raised by ``BOOST`` when a context word is near."""
    name: str
    pattern: str
    hint: str
    confirm: object
    base: float
    words: str


BOOST, ACCEPT = 0.3, 0.5
KINDS = (
    Kind("email", EMAIL, "@", None, 0.7, "mail|contact|write|kontakt|correo|courriel"),
    Kind("ip", IP, "[0-9]\\.[0-9]",
         lambda v: v.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"), 0.6, r"\bip\b|host|server|address"),
    Kind("card", CARD, "[0-9]", lambda v: between(12, 19)(v) & luhn(v), 0.7,
         "card|visa|credit|karte|tarjeta|carte"),
    Kind("phone", PHONE, "\\+[0-9]", between(9, 15), 0.6, "phone|call|tel|mobile|fax"),
    Kind("iban", IBAN, "[A-Z]{2}[0-9]{2}", mod97, 0.7, "iban|account|bank|konto|cuenta|compte"),
    Kind("ssn", SSN, "-[0-9]{2}-", None, 0.3, "ssn|social|security"),
)
BASE_KINDS = ("email", "ip", "card", "phone")


def _starts(lengths: Column) -> Column:
    """Running totals before each element, in blocks so that cost stays near linear."""
    count = F.size(lengths)
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, b: a + b)
    heads = F.transform(F.sequence(F.lit(0), (count / CHUNK).cast("int")),
                        lambda c: total(F.slice(lengths, F.lit(1), c * CHUNK)))
    return F.transform(F.array(heads), lambda h: F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.get(h, (i / CHUNK).cast("int")) + total(F.slice(
            lengths, (i / CHUNK).cast("int") * CHUNK + 1, i % CHUNK))))[0]


def find_spans(documents: DataFrame, text: str = "text", kinds=KINDS) -> DataFrame:
    """Adds ``pii``: array of (start, rank, kind, end, score, value) in text order.

    Offsets are code points, end exclusive. Spans of one kind never overlap; spans
    of different kinds may. Null and empty texts have no spans. Confirmed spans
    scoring under ``ACCEPT`` (an added kind without context) are left out; the
    base kinds always stay. Extra columns pass through.
    """
    names = [f"_{k.name}" for k in kinds]
    rows = documents.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    none = F.array().cast("array<string>")
    rows = rows.withColumns({n: F.when(
        F.col("_text").rlike(k.hint), F.regexp_extract_all("_text", F.lit(k.pattern), F.lit(0))
    ).otherwise(none) for n, k in zip(names, kinds)})
    rows = rows.withColumns({f"{n}_gaps": F.when(
        F.size(n) > 0, F.split("_text", k.pattern, -1)) for n, k in zip(names, kinds)})
    rows = rows.withColumns({f"{n}_at": F.when(F.size(n) > 0, _starts(F.zip_with(
        F.slice(f"{n}_gaps", F.lit(1), F.size(n)), n,
        lambda gap, found: F.length(gap) + F.length(found)))) for n in names})

    def spans(rank, kind, n):
        def one(i):
            value, gap = F.get(F.col(n), i), F.get(F.col(f"{n}_gaps"), i)
            start = F.get(F.col(f"{n}_at"), i) + F.length(gap)
            near = F.lower(F.concat(
                F.right(gap, F.lit(CONTEXT_CHARS)), F.lit(" "),
                F.left(F.get(F.col(f"{n}_gaps"), i + 1), F.lit(CONTEXT_CHARS))))
            score = F.lit(kind.base) + F.when(near.rlike(kind.words), BOOST).otherwise(0.0)
            return F.struct(start.cast("long").alias("start"), F.lit(rank).alias("rank"),
                            F.lit(kind.name).alias("kind"),
                            (start + F.length(value)).cast("long").alias("end"),
                            F.round(score, 2).alias("score"), value.alias("value"))
        found = F.transform(F.sequence(F.lit(0), F.size(n) - 1), one)
        if kind.confirm is not None:
            found = F.filter(found, lambda s: kind.confirm(s["value"]))
        if kind.name not in BASE_KINDS:
            found = F.filter(found, lambda s: s["score"] >= ACCEPT)
        return F.when(F.size(n) > 0, found)

    empty = "array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double,value:string>>"
    rows = rows.withColumns({f"{n}_spans": F.coalesce(spans(r, k, n), F.array().cast(empty))
                             for r, (n, k) in enumerate(zip(names, kinds))})
    rows = rows.withColumn("pii", F.array_sort(F.concat(*(f"{n}_spans" for n in names))))
    return rows.select(*documents.columns, "pii")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(documents: DataFrame, text: str = "text") -> DataFrame:
    """Replaces every found span by ``[KIND]``; overlapping spans by the first's mark.

    A null text stays null. All other columns pass through unchanged.
    """
    found = find_spans(documents, text)

    def cover(done, span):
        # done: end of the text written so far, and the pieces.
        start = F.greatest(done["at"], span["start"])
        piece = F.when(span["start"] >= done["at"], F.concat(
            F.substring(F.col(text), (done["at"] + 1).cast("int"),
                        (start - done["at"]).cast("int")),
            F.lit("["), F.upper(span["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.greatest(done["at"], span["end"]).alias("at"),
                        F.concat(done["out"], piece).alias("out"))
    masked = F.aggregate(
        "pii", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), cover,
        lambda done: F.concat(done["out"], F.substring(
            F.col(text), (done["at"] + 1).cast("int"), F.length(text))))
    return found.withColumn(text, F.when(F.size("pii") > 0, masked).otherwise(F.col(text))).select(
        *documents.columns)


def pii_digest(documents: DataFrame) -> DataFrame:
    """Counts and digests of the spans of every document (the query's columns)."""
    found = find_spans(documents.select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["rank"] < len(BASE_KINDS))

    def count(kind):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k in BASE_KINDS),
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"))
