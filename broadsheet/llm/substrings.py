"""Exact repeats of long substrings by difference-cover samples, one suffix block at a time.

A repeat of ``LENGTH`` bytes starting at p and q holds, for some d below ``PERIOD``, a
pair of cover samples p + d and q + d (residues in a difference cover take every
difference), and the ``STEM`` bytes after them are equal.

1. Cover samples are named by the hash of their stem. The samples of one block of the
   hash space are sorted together in one task, and those whose name occurs twice stay.
2. Only starts that reach such a sample can repeat (the precomputed ranks settle all
   others). Their whole prefix of ``LENGTH`` bytes is hashed, sorted block by block in
   the same way, and starts whose prefix occurs twice are the answer.

Blocks are packed with numpy; each task first joins equal names of its own, so a passage
that a third of all documents share costs one entry per task, not one per document. Equal
texts are found first: one of each takes part, and a text of ``LENGTH`` bytes or more
that occurs twice goes as a whole. Memory is bounded by ``FLUSH`` and the block size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm import shingles as S
from broadsheet.llm.storage import materialize

LENGTH = 200
# A perfect difference set modulo 133.
PERIOD = 133
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
STEM = LENGTH - PERIOD + 1
FLUSH = 1_000_000       # entries a task packs at once
BLOCK = 1_500_000       # entries of a block, about
LEAST_BLOCKS = 64
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64_000_000    # of the binaries, as they grow with the texts

PACKED = "block int, docs binary, counts binary, places binary, names binary"
_TABLES = S.mix(np.arange(1, 513, dtype=np.uint64)).reshape(2, 256)


def rolling(data: np.ndarray, which: int):
    """A function (starts, length) -> hashes of the substrings of ``data``."""
    up, down = S._Powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLES[which][data] * up[:len(data)], out=sums[1:])
    return lambda at, length: S.mix((sums[at + length] - sums[at]) * down[at])


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, byte by byte, so that zeros lie together."""
    wide = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return np.ascontiguousarray(wide[:, :width].T).tobytes()


def _unplanes(blob, width: int, dtype) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], np.dtype(dtype).itemsize), np.uint8)
    out[:, :width] = raw.T
    return out.view(dtype).ravel()


def _pack(docs: np.ndarray, places: np.ndarray):
    """Runs of equal documents, and their ascending places as differences."""
    heads = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    steps = places.astype(np.uint32).copy()
    steps[1:] -= places[:-1].astype(np.uint32)
    steps[heads] = places[heads]
    counts = np.diff(np.r_[heads, len(docs)]).astype(np.uint32)
    return docs[heads].tobytes(), _planes(counts, 4), _planes(steps, 4)


def _steps(places: np.ndarray) -> bytes:
    """Ascending places as differences, in planes."""
    return _planes(np.diff(places, prepend=np.uint32(0)).astype(np.uint32), 4)


def _unsteps(blob: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(blob, 4, np.uint32), dtype=np.int64)


def _unpack(docs, counts, places):
    docs, counts = np.frombuffer(docs, np.int64), _unplanes(counts, 4, np.uint32)
    steps = _unplanes(places, 4, np.uint32)
    heads = np.cumsum(counts) - counts
    total = np.cumsum(steps, dtype=np.uint64)
    base = np.repeat(total[heads] - steps[heads], counts)
    return np.repeat(docs, counts), (total - base).astype(np.uint32)


class _Packer:
    """Collects (doc, place, name) entries and emits them as packed blocks."""

    def __init__(self, blocks: int, width: int):
        self.blocks, self.width, self.parts, self.size = blocks, width, [], 0

    def add(self, docs, places, names, extra=None):
        self.parts.append((docs, places, names, extra))
        self.size += len(docs)

    def flush(self):
        if not self.size:
            return
        docs, places, names = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        extra = (np.concatenate([p[3] for p in self.parts]) if self.parts[0][3] is not None
                 else None)
        self.parts, self.size = [], 0
        order = np.argsort(names, kind="stable")
        named = names[order]
        first = np.r_[True, named[1:] != named[:-1]]
        if extra is not None:
            first[1:] |= extra[order][1:] != extra[order][:-1]
        heads = np.flatnonzero(first)
        many = np.diff(np.r_[heads, len(named)]) > 1
        known = np.zeros(len(named), bool)
        known[heads] = many
        rows = []
        # Entries equal to another of this task need no one else to be known as repeats.
        local = np.sort(order[~first | known])
        if len(local):
            rows.append((int(docs[local[0]] % self.blocks), *_pack(docs[local], places[local]), b""))
        block = ((named[heads] >> np.uint64(32)) * np.uint64(self.blocks) >> np.uint64(32)).astype(int)
        edges = np.searchsorted(block, np.arange(self.blocks + 1))
        for b in range(self.blocks):
            if edges[b] < edges[b + 1]:
                mine = np.sort(order[heads[edges[b]:edges[b + 1]]])
                name = _planes(names[mine], self.width)
                if extra is not None:
                    name += _planes(extra[mine], 2)
                rows.append((b, *_pack(docs[mine], places[mine]), name))
        for i in range(0, len(rows), 64):
            columns = list(zip(*rows[i:i + 64]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                ["block", "docs", "counts", "places", "names"])


def _positions(counts: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Concatenated ranges: for each row, counts values from firsts upwards."""
    return np.arange(counts.sum()) + np.repeat(firsts - (np.cumsum(counts) - counts), counts)


def _samples(blocks: int):
    cover = np.array(COVER)

    def run(batches):
        packer = _Packer(blocks, 5)
        for batch in batches:
            docs = batch.column("doc").to_numpy(zero_copy_only=False)
            for row, data, offsets in S.text_slices(batch.column("text")):
                lengths = np.diff(offsets)
                room = np.maximum(lengths - STEM + 1, 0)     # starts with a whole stem
                counts = room // PERIOD * len(COVER) + np.searchsorted(cover, room % PERIOD)
                nth = _positions(counts, np.zeros(len(counts), np.int64))
                places = nth // len(COVER) * PERIOD + cover[nth % len(COVER)]
                starts = places + np.repeat(offsets[:-1], counts)
                names = rolling(data, 0)(starts, STEM)
                packer.add(np.repeat(docs[row:row + len(counts)], counts),
                           places.astype(np.uint32), names)
                if packer.size >= FLUSH:
                    yield from packer.flush()
        yield from packer.flush()
    return run


def _prefixes(blocks: int):
    def run(batches):
        packer = _Packer(blocks, 6)
        for batch in batches:
            docs = batch.column("doc").to_numpy(zero_copy_only=False)
            ranks = batch.column("ranks")
            for row, data, offsets in S.text_slices(batch.column("text")):
                one, two = rolling(data, 0), rolling(data, 1)
                for i in range(len(offsets) - 1):
                    room = int(offsets[i + 1] - offsets[i]) - LENGTH + 1
                    if room <= 0:
                        continue
                    reach = np.zeros(room + PERIOD + 1, np.int32)
                    for blob in ranks[row + i].as_py():
                        at = _unsteps(blob)
                        np.add.at(reach, np.clip(at - PERIOD + 1, 0, room), 1)
                        np.add.at(reach, np.clip(at + 1, 0, room), -1)
                    places = np.flatnonzero(np.cumsum(reach)[:room] > 0)
                    starts = places + offsets[i]
                    packer.add(np.full(len(places), docs[row + i]), places.astype(np.uint32),
                               one(starts, LENGTH), two(starts, LENGTH).astype(np.uint16))
                    if packer.size >= FLUSH:
                        yield from packer.flush()
        yield from packer.flush()
    return run


def _repeats(width: int, extra: bool):
    """Of one block: the places whose name occurs twice, or is known to."""
    def run(table: pa.Table) -> pa.Table:
        docs, places, names, more, sure = [], [], [], [], []
        for row in table.select(["docs", "counts", "places", "names"]).to_pylist():
            d, p = _unpack(row["docs"], row["counts"], row["places"])
            if not row["names"]:
                sure.append((d, p))
                continue
            docs.append(d)
            places.append(p)
            cut = len(d) * width
            names.append(_unplanes(row["names"][:cut], width, np.uint64))
            if extra:
                more.append(_unplanes(row["names"][cut:], 2, np.uint16))
        if docs:
            d, p, n = map(np.concatenate, (docs, places, names))
            order = np.argsort(n, kind="stable")
            if extra:
                m = np.concatenate(more)
                order = np.lexsort((m, n))
            equal = n[order][1:] == n[order][:-1]
            if extra:
                equal &= m[order][1:] == m[order][:-1]
            twice = np.zeros(len(d), bool)
            twice[order[1:][equal]] = True
            twice[order[:-1][equal]] = True
            sure.append((d[twice], p[twice]))
        d, p = (np.concatenate([s[i] for s in sure]) for i in (0, 1))
        order = np.lexsort((p, d))
        d, p = d[order], p[order]
        heads = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.zeros(0, int)
        ends = np.r_[heads[1:], len(d)]
        return pa.table({"doc": pa.array(d[heads], pa.int64()), "places": pa.array(
            [_steps(p[a:b]) for a, b in zip(heads, ends)], pa.binary())})
    return run


def _blocks(entries: float) -> int:
    return max(LEAST_BLOCKS, int(entries / BLOCK) + 1)


def _maybe_broadcast(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _broadcast_or_shuffle(rows: DataFrame, size: Column) -> DataFrame:
    """Broadcast if the rows and their bytes are few; else a shuffle join, with skew split."""
    count, total = rows.agg(F.count("*"), F.sum(size)).first()
    if count <= BROADCAST_ROWS and (total or 0) <= BROADCAST_BYTES:
        return F.broadcast(rows)
    return rows.hint("shuffle_merge")


def _spans(table: pa.Table) -> pa.Table:
    """Of one document: the union of [place, place + LENGTH) as start, end pairs."""
    at = np.unique(np.concatenate(
        [_unsteps(b) for b in table.column("places").to_pylist()]))
    cut = np.flatnonzero(np.diff(at) > LENGTH)
    ends = at[np.r_[cut, len(at) - 1]] + LENGTH
    pairs = np.stack([at[np.r_[0, cut + 1]], ends], axis=1)
    return pa.table({"doc": table.column("doc").slice(0, 1),
                     "spans": pa.array([pairs.tobytes()], pa.binary())})


def repeated_spans(documents: DataFrame) -> DataFrame:
    """(doc, spans) of distinct texts: byte ranges that repeat elsewhere.

    ``documents`` has doc_id, doc (a hash of the text) and text; spans are pairs of
    64-bit integers, ascending, end exclusive, never touching.
    """
    long = documents.where(F.octet_length("text") >= LENGTH)
    copies = materialize(long.groupBy("doc").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("_least"),
        F.first(F.octet_length("text")).alias("size")).where("n > 1").select(
            "doc", "_least", "size"), "copies")
    # Of equal texts the one of the least id takes part; which one doesn't matter.
    once = long.join(_maybe_broadcast(copies.select(F.col("doc").alias("_doc"), "_least")),
                     F.col("doc") == F.col("_doc"), "left").where(
        F.col("_doc").isNull() | F.col("doc_id").eqNullSafe(F.col("_least"))).select("doc", "text")
    size = long.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = _blocks(size * len(COVER) / PERIOD)
    ranks = (once.mapInArrow(_samples(blocks), PACKED).groupBy("block")
             .applyInArrow(_repeats(5, False), "doc long, places binary"))
    ranks = materialize(ranks.groupBy("doc").agg(F.collect_list("places").alias("ranks")),
                        "cover-ranks")
    size_of = F.aggregate("ranks", F.lit(0).cast("long"), lambda n, b: n + F.length(b))
    likely = once.join(_broadcast_or_shuffle(ranks, size_of), "doc").select("doc", "text", "ranks")
    starts = (likely.mapInArrow(_prefixes(_blocks(size / 8)), PACKED).groupBy("block")
              .applyInArrow(_repeats(6, True), "doc long, places binary"))
    found = starts.groupBy("doc").applyInArrow(_spans, "doc long, spans binary")
    whole = copies.select("doc", F.lit(0).alias("_from"), "size")
    found = found.join(whole.select("doc"), "doc", "left_anti").unionByName(
        whole.mapInArrow(_whole, "doc long, spans binary"))
    return materialize(found, "spans")


def _whole(batches):
    for batch in batches:
        sizes = batch.column("size").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(
                [np.array([0, n], np.int64).tobytes() for n in sizes], pa.binary())],
            ["doc", "spans"])


def kept_bytes(text: str | None, spans: bytes | None) -> tuple[bytes, int, int, int]:
    """The bytes left, the length of the text, the bytes removed, the number of spans."""
    data = (text or "").encode()
    if not spans:
        return data, len(data), 0, 0
    at, left, gone = 0, [], 0
    pairs = np.frombuffer(spans, np.int64).reshape(-1, 2).tolist()
    for start, end in pairs:
        left.append(data[at:start])
        gone += end - start
        at = end
    return b"".join([*left, data[at:]]), len(data), gone, len(pairs)


def _digest(batches):
    for batch in batches:
        rows = [kept_bytes(t.as_py(), s.as_py())
                for t, s in zip(batch.column("text"), batch.column("spans"))]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)),
            pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def with_spans(documents: DataFrame) -> DataFrame:
    """Adds ``spans`` to (doc_id, text); null where nothing repeats."""
    keyed = documents.select("doc_id", "text").withColumn(
        "doc", F.xxhash64(F.coalesce("text", F.lit(""))))
    spans = repeated_spans(keyed)
    spans = _broadcast_or_shuffle(spans, F.length("spans"))
    return keyed.join(spans, "doc", "left").select("doc_id", "text", "spans")


def substring_dedup(documents: DataFrame) -> DataFrame:
    """Per document: bytes, bytes removed, removed runs, digest of the rest.

    Null reads as empty; texts under ``LENGTH`` bytes lose nothing. Rows with equal texts
    get equal results whatever their ids, one per row. Every occurrence of a repeat goes,
    the first one too.
    """
    return with_spans(documents).mapInArrow(
        _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
