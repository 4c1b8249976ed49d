"""Benchmark decontamination by winnowed word fingerprints.

Every window of ``WINDOW`` words holds ``WINDOW - GRAM + 1`` grams of ``GRAM`` words.
Keeping the least gram hash of each window on both sides guarantees that a window
shared by a document and a benchmark item leaves at least one common fingerprint at
the same place. Joined fingerprints give alignments; each alignment is compared word
by word, so the result is exact. Items shorter than a window are looked up as whole
grams of their own length.

Only ids, positions and hashes are shuffled. A passage shared by many documents costs
one row per occurrence; equal benchmark texts are one class; the benchmark side is
broadcast only after its rows were counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.storage import materialize

WINDOW, GRAM = 13, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# A low word position rides in the gram hash, so that a minimum carries its place; a
# text of 2 GB, the largest possible, has fewer words than 2^30.
PLACE_BITS = 30
PLACE = (1 << PLACE_BITS) - 1
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; an empty list for null."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, UPPER, LOWER), NO_WORD), ""),
                      F.array().cast("array<string>"))


def fold(text: Column) -> Column:
    """A faster, coarser fold: words that are equal stay equal.

    ``lower`` folds a capital sigma by its neighbours, so that one goes first.
    """
    return F.lower(F.replace(text, F.lit("Σ"), F.lit("σ")))


def folded_words_of(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(fold(text), NO_WORD), ""),
                      F.array().cast("array<string>"))


def count_words(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, NO_WORD), "")), F.lit(0)).cast("long")


def gram_hashes(words: str, size: int, least: int) -> Column:
    """Hash of each gram with its place in the low bits; null under ``least`` words."""
    return F.when(F.size(words) >= least, F.transform(
        F.sequence(F.lit(0), F.size(words) - size),
        lambda i: F.xxhash64(F.slice(words, i + 1, size)).bitwiseAND(F.lit(~PLACE))
        .bitwiseOR(i.cast("long"))))


def winnow(rows: DataFrame, words: str, *keep: str) -> DataFrame:
    """One row per kept fingerprint: ``keep``, ``mark`` (hash) and ``place``."""
    span = WINDOW - GRAM + 1
    return _unpack(
        rows.withColumn("_grams", gram_hashes(words, GRAM, WINDOW))
        .withColumn("_kept", F.array_distinct(F.transform(
            F.when(F.col("_grams").isNotNull(), F.sequence(F.lit(0), F.size("_grams") - span)),
            lambda i: F.array_min(F.slice("_grams", i + 1, span))))), keep)


def whole_grams(rows: DataFrame, words: str, size: int, *keep: str) -> DataFrame:
    return _unpack(rows.withColumn("_kept", gram_hashes(words, size, size)), keep)


def _unpack(rows: DataFrame, keep) -> DataFrame:
    # Outer, as Spark would else test the size of the list by computing it once more.
    flat = rows.select(*keep, F.explode_outer("_kept").alias("_mark")).where("_mark IS NOT NULL")
    return flat.select(*keep, F.shiftright("_mark", PLACE_BITS).alias("mark"),
                       F.col("_mark").bitwiseAND(F.lit(PLACE)).cast("int").alias("place"))


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct item texts with their words, and the ids of each."""
    held = materialize(benchmark.select(
        "item_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("item"),
        words_of(F.col("text")).alias("item_words")).where(F.size("item_words") > 0),
        "decontaminate-items")
    texts = held.groupBy("item").agg(F.first("item_words").alias("item_words"))
    ids = held.select("item", F.coalesce(F.col("item_id").cast("string"), F.lit(""))
                      .alias("item_id")).distinct()
    return materialize(texts, "decontaminate-texts"), ids


def _joined(marks: DataFrame, index: DataFrame) -> DataFrame:
    """Alignments: the document word at which an item's first word would stand."""
    if index.count() <= BROADCAST_ROWS:
        index = F.broadcast(index)
    return marks.join(index, "mark").select(
        "doc_id", "doc", "item", (F.col("place") - F.col("item_place")).alias("shift"))


def find_alignments(documents: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct (doc_id, doc, item, shift) that share a fingerprint."""
    docs = documents.select("doc_id", "doc", folded_words_of(F.col("text")).alias("words"))
    # Words are folded the same way on both sides: one by one, without neighbours.
    folded = texts.withColumn("words", F.transform("item_words", lambda w: fold(w)))
    index = materialize(winnow(folded, "words", "item").withColumnRenamed("place", "item_place"),
                        "decontaminate-index")
    found = _joined(winnow(docs, "words", "doc_id", "doc"), index)
    sizes = texts.select(F.size("item_words").alias("n")).where(F.col("n") < WINDOW)
    # At most WINDOW - 1 different lengths.
    for (size,) in sorted(sizes.distinct().collect()):
        short = folded.where(F.size("item_words") == size)
        index = materialize(whole_grams(short, "words", size, "item")
                            .withColumnRenamed("place", "item_place"), "decontaminate-index")
        found = found.union(_joined(whole_grams(docs, "words", size, "doc_id", "doc"), index))
    return found.distinct()


def find_hits(documents: DataFrame, texts: DataFrame) -> DataFrame:
    """Confirmed hits: (doc_id, doc, item, place), one row per hit document word and item."""
    alignments = materialize(find_alignments(documents, texts), "decontaminate-alignments")
    # An alignment list is bounded by one document's length; the item words ride along.
    listed = (alignments.join(texts, "item")
              .groupBy("doc_id", "doc")
              .agg(F.collect_list(F.struct("item", "shift", "item_words")).alias("_found")))
    listed = materialize(listed, "decontaminate-listed")
    rows = (documents.alias("d").join(
        listed.alias("l"), F.col("d.doc").eqNullSafe(F.col("l.doc"))
        & F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")))
        .select("d.doc_id", "d.doc", "d.text", "_found").dropDuplicates(["doc_id", "doc"])
        .select("doc_id", "doc", words_of(F.col("text")).alias("words"), "_found"))

    def places(found):
        size = F.size(found["item_words"])
        width = F.least(F.lit(WINDOW), size)
        first = F.greatest(F.lit(0), -found["shift"])
        shared = F.least(size, F.size("words") - found["shift"]) - first
        equal = F.zip_with(F.slice("words", found["shift"] + first + 1, shared),
                           F.slice(found["item_words"], first + 1, shared), lambda a, b: a == b)
        starts = F.filter(F.sequence(F.lit(0), shared - width), lambda j: F.forall(
            F.slice(equal, j + 1, width), lambda x: x))
        covered = F.array_distinct(F.flatten(F.transform(starts, lambda j: F.sequence(
            found["shift"] + first + j, found["shift"] + first + j + width - 1))))
        return F.struct(found["item"].alias("item"),
                        F.when(shared >= width, covered).alias("places"))
    hits = rows.select("doc_id", "doc", F.explode_outer(F.transform("_found", places)).alias("hit"))
    return hits.select("doc_id", "doc", "hit.item", F.explode_outer("hit.places").alias("place")
                       ).where("place IS NOT NULL")


def with_hash(documents: DataFrame) -> DataFrame:
    """Adds ``doc``, a hash of the text: with the id it names a row up to exact repeats."""
    return documents.withColumn("doc", F.xxhash64(F.coalesce("text", F.lit(""))))


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, hit words, items with occurring windows, and the verdict.

    A null text has no words. Rows with equal id and text get equal results, one per
    row. Equal items count by their ids; a null item id reads as the empty string.
    Empty tables give no hits (or no rows).
    """
    documents = with_hash(documents.select("doc_id", "text"))
    texts, ids = _items(benchmark.select("item_id", "text"))
    hits = materialize(find_hits(documents, texts), "decontaminate-hits")
    words = hits.groupBy("doc_id", "doc", "place").agg(F.lit(1).alias("_1")).groupBy(
        "doc_id", "doc").agg(F.count("*").alias("n_hit"))
    items = (hits.select("doc_id", "doc", "item").distinct().join(ids, "item")
             .groupBy("doc_id", "doc").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    per = materialize(words.alias("w").join(
        items.alias("i"), F.col("w.doc").eqNullSafe(F.col("i.doc"))
        & F.col("w.doc_id").eqNullSafe(F.col("i.doc_id")))
        .select("w.doc_id", "w.doc", "n_hit", "items"), "decontaminate-per")
    counted = documents.select("doc_id", "doc", count_words(F.col("text")).alias("n_words"))
    joined = counted.alias("c").join(
        per.alias("p"), F.col("c.doc").eqNullSafe(F.col("p.doc"))
        & F.col("c.doc_id").eqNullSafe(F.col("p.doc_id")), "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "c.doc_id", "n_words", hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"), "c.doc")


def remove_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    bad = contamination(documents, benchmark).where("contaminated").select(
        F.col("doc_id").alias("_id"), F.col("doc").alias("_doc")).distinct()
    bad = materialize(bad, "decontaminate-bad")
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    return documents.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (own == F.col("_doc")),
                          "left_anti")
