"""Ranked lexical search in reverse: documents stream through an index of the queries.

The queries (items) are few and known, the documents many. So the inverted index is built
over the items' terms and sent to the tasks, a block of items of bounded size at a time;
blocks go one after the other, whatever the number of items.

1. A map counts the terms of each document: its length and, for terms that some item of
   the block holds, how often. Document frequencies, the number of documents and their
   total length are sums over that written table.
2. A second map takes each document's counts through the postings of its terms and adds up
   the scores of all items that share a term with it. Each task keeps one bounded heap per
   item; a score below the heap's least never enters.
3. The heaps are merged: first in salted groups, then per item.

Scores are whole numbers; sums stay exact in doubles as long as they are under 2^53, which
``_index`` checks for each item; items beyond it are added up as integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from broadsheet.llm.storage import materialize

TOP = 10
BLOCK_BYTES = 8 << 20       # of item texts whose index is sent to the tasks at once
SLICE_BYTES = 1 << 21
SCORES = 1 << 20            # cells of one table of scores
WAITING = 1 << 14           # scores that wait to be sorted into the heaps
EXACT = 1 << 53
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_IN_TERM = np.ones(256, bool)
_IN_TERM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms_of(texts: pa.Array):
    """Slices of a text column as (first row, terms, borders of the rows in terms).

    Terms are the maximal matches of ``TERM`` with A-Z lower-cased; a null has none.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[
        texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        end = min(max(end, row + 1), len(texts))
        part, rows = data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        inside = _IN_TERM[part]
        fresh = np.zeros(len(part) + 1, bool)
        fresh[rows] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | fresh[1:-1]
        starts = np.flatnonzero(first)
        # Only bytes of terms are kept, so each term ends where the next one starts.
        kept = np.concatenate([[0], np.cumsum(inside)])
        bounds = np.append(kept[starts], kept[-1])
        terms = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts),
            [None, pa.py_buffer(bounds), pa.py_buffer(_LOWER[part[inside]])])
        yield row, terms, np.searchsorted(starts, rows)
        row = end


def _count(vocabulary: pa.Array):
    """Maps to (doc_id, n, term numbers, counts); numbers and counts are packed int32."""
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for row, terms, rows in terms_of(batch.column("text")):
                known = pc.index_in(terms, value_set=vocabulary)
                at = np.flatnonzero(known.is_valid().to_numpy(zero_copy_only=False))
                term = known.fill_null(0).to_numpy(zero_copy_only=False)[at].astype(np.int64)
                doc = np.searchsorted(rows, at, "right") - 1
                key, tf = np.unique(doc * len(vocabulary) + term, return_counts=True)
                doc, term = key // len(vocabulary), (key % len(vocabulary)).astype("<i4")
                edge = 4 * np.searchsorted(doc, np.arange(len(rows))).astype(np.int32)
                packed = [pa.Array.from_buffers(
                    pa.binary(), len(rows) - 1,
                    [None, pa.py_buffer(edge), pa.py_buffer(values.astype("<i4"))])
                    for values in (term, tf)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(rows) - 1), pa.array(np.diff(rows)), *packed],
                    ["doc_id", "n", "terms", "counts"])
    return run


def _frequencies(size: int):
    """Each task's documents with a term, their lengths, and documents per term."""
    def run(batches):
        held, documents, length = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            documents, length = documents + int((n > 0).sum()), length + int(n.sum())
            terms = np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4")
            held += np.bincount(terms, minlength=size)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, -2, *some.tolist()], pa.int64()),
             pa.array([documents, length, *held[some].tolist()], pa.int64())], ["term", "held"])
    return run


def _index(items: list[np.ndarray], weights: np.ndarray):
    """Postings by term: borders, items, weight times repeats; and whether sums are exact."""
    item = np.repeat(np.arange(len(items)), [len(t) for t in items])
    term = np.concatenate([*items, np.zeros(0, np.int64)]).astype(np.int64)
    # A weight of 0 can't add to a score.
    item, term = item[weights[term] > 0], term[weights[term] > 0]
    key, repeats = np.unique(term * max(1, len(items)) + item, return_counts=True)
    term, item = key // max(1, len(items)), key % max(1, len(items))
    worth = weights[term] * repeats
    edges = np.searchsorted(term, np.arange(len(weights) + 1))
    # One term adds at most a million times its weight.
    most = np.bincount(item, worth.astype(float), minlength=len(items)) * 1e6
    return edges, item, worth, bool((most < EXACT).all())


class _Heaps:
    """The best ``top`` documents of each item so far: high score first, then low id."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.least = np.ones(items, np.int64)       # to enter, a score must reach it
        self.rows = np.zeros((0, 4), np.int64)      # item, -score, null id, id
        self.waiting: list[np.ndarray] = []

    def offer(self, table, null, doc) -> None:
        """A table of scores, a row per document and a column per item."""
        enters = table >= self.least
        if enters.sum() > 4 * self.top * len(self.least) and len(table) > self.top:
            # What is not among the best of this table can't be among the best of all.
            at = len(table) - self.top
            enters &= table >= np.partition(table, at, axis=0)[at]
        row, item = np.nonzero(enters)
        score = table[row, item].astype(np.int64)
        self.waiting.append(np.stack([item, -score, null[row], doc[row]], axis=1))
        if sum(map(len, self.waiting)) > len(self.rows) + WAITING:
            self.settle()

    def settle(self) -> np.ndarray:
        rows = np.concatenate([self.rows, *self.waiting])
        self.waiting.clear()
        rows = rows[np.lexsort(rows.T[::-1])]
        place = np.arange(len(rows)) - np.searchsorted(rows[:, 0], rows[:, 0])
        self.rows = rows[place < self.top]
        full = rows[place == self.top - 1]
        self.least[full[:, 0]] = -full[:, 1]
        return self.rows


def _score(index, documents: int, length: int, items: int, top: int):
    edges, posted, worth, exact = index
    dtype = np.float64 if exact else np.int64

    def scores(term, tf, doc, n, rows):
        m = 100 - 75 + 75 * n * documents // length
        part = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        counts = edges[term + 1] - edges[term]
        upto = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(edges[term] - upto[:-1], counts) + np.arange(upto[-1])
        cell = np.repeat(doc * items, counts) + posted[at]
        added = worth[at] * np.repeat(part, counts)
        if exact:
            table = np.bincount(cell, added, minlength=rows * items)
        else:
            table = np.zeros(rows * items, dtype)
            np.add.at(table, cell, added)
        return table.reshape(rows, items)

    def run(batches):
        heaps = _Heaps(items, top)
        step = max(1, SCORES // max(1, items))
        for batch in batches:
            for first in range(0, len(batch), step):
                part = batch.slice(first, step)
                raw = part.column("terms").to_pylist()
                term = np.frombuffer(b"".join(raw), "<i4").astype(np.int64)
                tf = np.frombuffer(b"".join(part.column("counts").to_pylist()), "<i4")
                if not len(term):
                    continue
                doc = np.repeat(np.arange(len(raw)), [len(r) // 4 for r in raw])
                table = scores(term, tf.astype(np.int64), doc,
                               part.column("n").to_numpy(), len(raw))
                ids = part.column("doc_id")
                heaps.offer(table, ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64),
                            ids.fill_null(0).to_numpy())
        item, score, null, doc = heaps.settle().T
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(doc, mask=null.astype(bool)), pa.array(-score),
             pa.array(np.full(len(item), TaskContext.get().partitionId() % 64))],
            ["item", "doc_id", "score", "salt"])
    return run


def _best(rows: DataFrame, top: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _rank_block(documents: DataFrame, texts: list[str], top: int) -> DataFrame:
    """(item, rank, doc_id, score); ``item`` is the place in ``texts``."""
    rows = [[bytes(t) for t in terms[a:b].to_pylist()]
            for _, terms, borders in terms_of(pa.array(texts, pa.string()))
            for a, b in zip(borders, borders[1:])]
    words = sorted(set().union(*rows))
    number = {w: i for i, w in enumerate(words)}
    items = [np.array([number[w] for w in row], np.int64) for row in rows]
    vocabulary = pa.array(words or [b""], pa.large_binary())
    counted = materialize(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _count(vocabulary), "doc_id long, n long, terms binary, counts binary"), "term-counts")
    held = np.zeros(len(vocabulary), np.int64)
    total = {-1: 0, -2: 0}
    for term, many in counted.mapInArrow(_frequencies(len(vocabulary)), "term long, held long"
                                         ).groupBy("term").agg(F.sum("held")).collect():
        if term < 0:
            total[term] = many
        else:
            held[term] = many
    number_of, length = total[-1], max(1, total[-2])
    weights = np.array([math.floor(1000 * math.log((2 * number_of + 2) / (2 * df + 1)))
                        for df in held.tolist()], np.int64)
    found = counted.where(F.length("terms") > 0).mapInArrow(
        _score(_index(items, weights), number_of, length, len(items), top),
        "item long, doc_id long, score long, salt long")
    merged = _best(found, top, "item", "salt").drop("rank", "salt")
    return _best(merged, top, "item").select("item", "rank", "doc_id", "score")


def rank_documents(documents: DataFrame, items: DataFrame, top: int = TOP,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``top`` documents of every item: item_id, rank, doc_id, score.

    Items of one text are searched once. A null or empty item or document has no terms; an
    item without a hit has no row. Equal scores go by ascending doc_id, null ids last; rows
    that repeat are documents of their own. Repeated items give repeated rows.
    """
    spark = documents.sparkSession
    named = items.select("item_id", F.coalesce("text", F.lit("")).alias("_text"),
                         F.sha2(F.coalesce("text", F.lit("")), 256).alias("_name"))
    distinct = named.select("_name", "_text").dropDuplicates(["_name"])
    size = distinct.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    distinct = distinct.withColumn("_block", F.pmod(F.xxhash64("_name"), F.lit(blocks)))
    if blocks > 1:
        distinct = materialize(distinct, "items")
    found = None
    for block in range(blocks):
        rows = distinct.where(F.col("_block") == block).orderBy("_name").collect()
        if not rows:
            continue
        best = _rank_block(documents, [r._text for r in rows], top)
        names = spark.createDataFrame(list(enumerate(r._name for r in rows)),
                                      "item long, _name string")
        best = best.join(F.broadcast(names), "item").drop("item")
        if blocks > 1:
            best = materialize(best, "ranked")
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], "rank int, doc_id long, score long, _name string")
    return named.select("item_id", "_name").join(found, "_name").select(
        "item_id", "rank", "doc_id", "score")
