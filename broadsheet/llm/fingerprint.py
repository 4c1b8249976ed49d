"""Document fingerprints: one-permutation MinHash, optimal densification, b-bit packing.

Shingle hashes of five words are binned once by their high bits; the least of each of
``BINS`` bins is kept. An empty bin asks other bins in an order fixed for it alone and
takes the first full one. Of each bin the low ``BITS`` bits are stored, a hexadecimal
digit; the share of equal digits, corrected for chance, estimates the Jaccard likeness.

Everything is a Column expression within a row. The one shuffle brings documents that
follow each other in id order into the same bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from broadsheet.llm.ordering import id_buckets

WORDS, BITS, BIN_BITS = 5, 4, 8
BINS = 1 << BIN_BITS
SHIFT = 64 - BIN_BITS
PROBES = 6
ROWS_PER_BUCKET = 512


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def signature(text: Column) -> Column:
    """``BINS`` hashes in bin order; null for a text without words.

    Words are lower-cased and parted by white space. Fewer than five words are one
    shingle.
    """
    words = F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")
    shingles = _let(words, lambda w: F.when(F.size(w) > 0, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(w) - WORDS, F.lit(0))),
        lambda i: F.xxhash64(F.slice(w, i + 1, WORDS)))))
    # The greatest value of a bin marks it; it comes first only where the bin is empty.
    marks = F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)),
                        lambda b: F.shiftleft(b.cast("long"), SHIFT).bitwiseOR(
                            F.lit((1 << SHIFT) - 1)))
    least = _let(F.sort_array(F.concat(shingles, marks)), lambda h: F.filter(
        h, lambda x, i: (i == 0) | (F.shiftright(x, SHIFT)
                                    != F.shiftright(F.get(h, i - 1), SHIFT))))
    bins = F.transform(least, lambda x: F.when(
        x.bitwiseAND(F.lit((1 << SHIFT) - 1)) != (1 << SHIFT) - 1, x))

    def ask(step):
        def one(sig):
            # sig: the bins as they were, and as they are filled.
            return F.struct(sig["full"].alias("full"), F.transform(
                sig["now"], lambda x, j: F.coalesce(x, F.get(sig["full"], F.pmod(
                    F.xxhash64(j, F.lit(step)), F.lit(BINS)).cast("int")))).alias("now"))
        return one

    def rest(sig):
        places = F.transform(sig["full"], lambda x, j: F.when(x.isNotNull(), j))
        filled = _let(F.filter(places, lambda j: j.isNotNull()), lambda there: F.transform(
            sig["now"], lambda x, j: F.coalesce(x, F.get(sig["full"], F.array_min(F.transform(
                there, lambda k: F.struct(F.xxhash64(j, k, F.lit(PROBES)).alias("r"),
                                          k.alias("k"))))["k"]))))
        return F.when(F.exists(sig["now"], lambda x: x.isNull()), filled).otherwise(sig["now"])
    state = _let(bins, lambda b: F.struct(b.alias("full"), b.alias("now")))
    for step in range(PROBES):
        state = _let(state, ask(step))
    return F.when(F.size(words) > 0, _let(state, rest))


def pack(sig: Column) -> Column:
    """One hexadecimal digit per bin; a text without words has the empty fingerprint.

    The bin is hashed in with the value, so that copies of one value in many bins, as a
    short text has, agree with another's by chance in each bin anew.
    """
    return F.coalesce(F.array_join(F.transform(sig, lambda x, j: F.substring(
        F.lit("0123456789abcdef"),
        (F.xxhash64(x, j).bitwiseAND(F.lit((1 << BITS) - 1)) + 1).cast("int"),
        F.lit(1))), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two fingerprints, from 0 to 1.

    Two empty fingerprints are alike (1); an empty and another are not (0).
    """
    equal = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y),
                            lambda e: e)) / F.lit(float(BINS))
    chance = 1.0 / (1 << BITS)
    return (F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0)
            .otherwise(F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))))


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every whole text; null reads as empty."""
    return documents.select("doc_id", pack(signature(F.coalesce("text", F.lit("")))).alias(
        "fingerprint"))


def with_next(documents: DataFrame) -> DataFrame:
    """(doc_id, text, next_id, ...) where next follows in ascending id order.

    Null ids come first; rows of equal id are in text order. After the last row comes
    the first. Each bucket also gets the first row of the bucket after it, a copy that
    only lends its text.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", id_buckets(rows, "doc_id", ROWS_PER_BUCKET))
    first = F.struct("doc_id", "text")
    heads = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "bucket")).alias("head"))
    heads = heads.select("bucket", F.col("head.doc_id").alias("_id"))
    # One row per bucket, of which there is a bounded number.
    order = Window.orderBy("bucket")
    before = heads.select("bucket", "_id", F.coalesce(
        F.lag("bucket").over(order),
        F.max("bucket").over(Window.partitionBy(F.lit(1)))).alias("to"))
    lent = rows.join(F.broadcast(before), "bucket").where(F.col("doc_id").eqNullSafe(F.col("_id")))
    lent = lent.groupBy("to").agg(F.min(first).alias("f")).select(
        F.col("to").alias("bucket"), F.col("f.doc_id").alias("doc_id"),
        F.col("f.text").alias("text"), F.lit(True).alias("lent"))
    return rows.select("bucket", "doc_id", "text", F.lit(False).alias("lent")).unionByName(lent)


def fingerprint_report(documents: DataFrame) -> DataFrame:
    """Per document: fingerprints of its text and of its edited text, and likenesses.

    The edited text has its last half (rounded down) of code points replaced by the
    first as many, or all, of the next document. Equal texts have equal fingerprints.
    A single document is its own next. One row per row, repeats and null ids too.
    """
    rows = with_next(documents)
    order = Window.partitionBy("bucket").orderBy("lent", "doc_id", "text")
    n = F.length("text")
    rows = rows.withColumn("next_text", F.lead("text").over(order))
    rows = rows.select("bucket", "doc_id", "text", "lent", n.cast("long").alias("n_chars"),
                       F.concat(F.left(F.col("text"), n - F.floor(n / 2).cast("int")), F.left(
                           F.col("next_text"), F.floor(n / 2).cast("int"))).alias("edited"))
    rows = rows.select("bucket", "doc_id", "text", "lent", "n_chars",
                       F.sha2("edited", 256).alias("edited_sha256"),
                       pack(signature(F.col("text"))).alias("fingerprint"),
                       F.when(~F.col("lent"), pack(signature(F.col("edited")))).alias(
                           "edited_fingerprint"))
    rows = rows.withColumn("_next", F.lead("fingerprint").over(order))
    return rows.where("NOT lent").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"))
