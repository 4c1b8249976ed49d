"""Near-duplicate documents: banded one-permutation MinHash and star-shaped candidates.

1. Each text becomes its set of five-word shingle hashes; equal sets are one class, so
   thousands of exact copies are one node from here on.
2. A class has ``BANDS`` keys of ``ROWS`` bins each. A pair at the threshold shares no
   key with a chance of about four in a million.
3. A shingle that no other candidate has can't be shared, so a class of which under
   three quarters of the shingles occur elsewhere links with nothing. In each bucket the
   other classes are paired with one centre (a star), the class with the most shared
   shingles, never with each other, and each pair is confirmed on the full sets.
4. Where a bucket still holds several components, its members outside the centre's
   component become centres of further stars over the members of other components,
   until every such member has been one. So no link that a bucket holds is lost, and
   a group that has become one component costs nothing more. Of these stars only edges
   that pass a bound on the common shingles are formed: a set bit of one class that the
   other lacks proves a shingle it lacks. The bound never drops a link.

Skew: a class is one row however often it occurs; hot buckets are counted by partial
aggregates and joined with splittable joins; no bucket is gathered in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm import shingles as S
from broadsheet.llm.storage import materialize, short_batches, trimmed

BANDS, ROWS = 64, 6
NUMERATOR, DENOMINATOR = 75, 100
# A bucket's further centres come in rounds that grow by this factor; all get their turn.
GROWTH = 32
# Bits of a class, one for each value of the last bits of its shingle hashes, in longs.
LONGS = 16
BROADCAST_ROWS = 200_000
# Full sets up to these bytes are sent to their pairs, more are shuffled.
SENT_BYTES = 8 << 20
# Of the bit tables that thin rows out before a join with more keys than that.
BITS_PER_KEY, MOST_LONGS = 32, 1 << 20


def with_hash(documents: DataFrame) -> DataFrame:
    return documents.withColumn("doc", F.xxhash64(F.coalesce("text", F.lit(""))))


def _class_ids(sets: list[np.ndarray]) -> list[bytes]:
    """128 bits that name a set: two sums over differently mixed elements."""
    return [b"" if not len(s) else
            int(s.sum(dtype=np.uint64)).to_bytes(8, "little")
            + int(S.mix(s ^ S._MIX[2]).sum(dtype=np.uint64)).to_bytes(8, "little") for s in sets]


@trimmed
def _sign(batches):
    for batch in batches:
        texts = batch.column("text")
        for first in range(0, len(batch), 512):
            part = batch.slice(first, 512)
            sets = list(S.shingle_sets(texts.slice(first, 512)))
            keys = S.band_hashes(S.one_permutation(sets, BANDS * ROWS), BANDS, ROWS)
            filled = np.array([len(s) > 0 for s in sets], bool)
            lengths = np.where(filled, BANDS, 0)
            flat = keys[filled].astype(np.uint64).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("doc"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(_class_ids(sets), pa.binary()),
                pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()),
                    pa.array(flat, pa.int64())),
            ], ["doc_id", "doc", "n_shingles", "class", "bands"])


def sign(documents: DataFrame) -> DataFrame:
    """Per document: set size, class of equal sets (empty without words), band keys."""
    return documents.select("doc_id", "doc", "text").mapInArrow(
        _sign, "doc_id long, doc long, n_shingles long, class binary, bands array<long>")


@trimmed
def _write_sets(batches):
    for batch in batches:
        for first in range(0, len(batch), 512):
            part = batch.slice(first, 512)
            sets = list(S.shingle_sets(part.column("text")))
            bits = np.zeros((len(sets), 64 * LONGS), bool)
            for row, values in zip(bits, sets):
                row[(values % np.uint64(64 * LONGS)).astype(np.int64)] = True
            bits = np.packbits(bits, axis=1).view("<i8")
            yield pa.RecordBatch.from_arrays(
                [part.column("class"), *_halves(part.column("class")),
                 pa.array([s.tobytes() for s in sets], pa.binary()),
                 pa.FixedSizeListArray.from_arrays(pa.array(bits.ravel()), LONGS
                                                   ).cast(pa.list_(pa.int64()))],
                ["class", "low", "high", "set", "bits"])


def _halves(classes) -> list[pa.Array]:
    """A class as two integers, which aggregates handle without sorting."""
    pairs = np.frombuffer(b"".join(classes.to_pylist()), "<i8").reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)]


@trimmed
def _elements(batches):
    for batch in batches:
        low, high = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("low", "high"))
        for first in range(0, len(batch), 256):
            sets = batch.column("set").slice(first, 256).to_pylist()
            sizes = [len(s) // 8 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(b"".join(sets), np.int64)),
                 pa.array(np.repeat(low[first:first + 256], sizes)),
                 pa.array(np.repeat(high[first:first + 256], sizes))], ["shingle", "low", "high"])


def shared_sizes(sets: DataFrame) -> DataFrame:
    """(class, n, shared): set size, and how many elements other sets have too."""
    alone = (sets.select("low", "high", "set").mapInArrow(
        _elements, "shingle long, low long, high long").groupBy("shingle").agg(
            F.count("*").alias("n"), F.min("low").alias("low"), F.min("high").alias("high"))
        .where("n = 1").groupBy("low", "high").agg(F.count("*").alias("alone")))
    size = (F.length("set") / 8).cast("long")
    return sets.select("class", "low", "high", size.alias("n")).join(
        alone, ["low", "high"], "left").select(
            "class", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"))


@trimmed
def _confirm(batches):
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("set_a"), batch.column("set_b")):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach the threshold.

    Only the sets of classes that stand in a pair move; ``pairs`` are written already.
    """
    asked = pairs.select(F.explode(F.array("a", "b")).alias("class"))
    few = asked.count() <= BROADCAST_ROWS
    if not few:
        asked = materialize(asked.distinct(), "asked")
    sets = _among(sets.select("class", "set"), "class", asked)
    if few and (sets.agg(F.sum(F.length("set"))).first()[0] or 0) <= SENT_BYTES:
        sets = F.broadcast(sets)
    return (pairs.join(sets.select(F.col("class").alias("a"), F.col("set").alias("set_a")), "a")
            .join(sets.select(F.col("class").alias("b"), F.col("set").alias("set_b")), "b")
            .select("a", "b", "set_a", "set_b").mapInArrow(_confirm, "a binary, b binary"))


def _may_link():
    """What two sets can share at most, against what the threshold takes."""
    return ((NUMERATOR + DENOMINATOR) * F.least("shared_a", "shared_b")
            >= NUMERATOR * (F.col("n_a") + F.col("n_b")))


def _bits_may_link():
    """The same bound from the bits: each set has shingles that the other can't have."""
    def own(a, b):
        return sum((F.bit_count(F.col(f"{a}.b{i}").bitwiseAND(F.bitwise_not(F.col(f"{b}.b{i}"))))
                    for i in range(LONGS)), F.lit(0))
    most = F.least(F.col("n_a") - own("bits_a", "bits_b"), F.col("n_b") - own("bits_b", "bits_a"))
    return (NUMERATOR + DENOMINATOR) * most >= NUMERATOR * (F.col("n_a") + F.col("n_b"))


def _maybe_broadcast(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _thinned(rows: DataFrame, key: str, wanted: DataFrame, count: int) -> DataFrame:
    """All ``rows`` with a ``key`` in ``wanted``, and few others, without a shuffle.

    A table of bits, one for each hash of a key, is sent; its size is bounded, so beyond
    it more of the others stay.
    """
    longs = min(MOST_LONGS, 1 << (BITS_PER_KEY * count // 64).bit_length())
    place = f"pmod(xxhash64({key}), {64 * longs}L)"
    table = wanted.groupBy(F.expr(f"shiftright({place}, 6)").alias("_at")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast({place} & 63 AS int)))").alias("_bits"))
    return rows.withColumn("_place", F.expr(place)).join(
        F.broadcast(table), F.expr("_at = shiftright(_place, 6)")).where(
            "getbit(_bits, cast(_place & 63 AS int)) = 1").select(*rows.columns)


def _among(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The ``rows`` with a ``key`` in ``wanted``, a written table; of distinct keys, if long."""
    count = wanted.count()
    if count <= BROADCAST_ROWS:
        return rows.join(F.broadcast(wanted), key, "left_semi")
    return _thinned(rows, key, wanted, count).join(wanted, key)


def components(edges: DataFrame) -> DataFrame:
    """Connected components: (class, root), root the least class of each.

    Alternates large-star and small-star steps until each component is a star around its
    least node, which the neighbours of the nodes tell without a further step; each step
    takes minima per node by partial aggregates, so a hub is no hot key.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .where("u <> v"), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = materialize(both.groupBy("u").agg(
            F.min("v").alias("least"), F.max("v").alias("most")), "neighbours")
        # In such stars a node with a lesser neighbour has no other one.
        nodes, unsettled = near.agg(F.count("*"), F.count_if(F.expr(
            "least < u AND least < most"))).first()
        if not unsettled:
            break
        sent = F.broadcast if nodes <= BROADCAST_ROWS else lambda rows: rows
        least = near.select("u", F.least("u", "least").alias("m"))
        edges = both.join(sent(least), "u").where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = edges.join(sent(least), "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(
                "u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(edges, "edges")
    return near.where("least < u").select(F.col("u").alias("class"), F.col("least").alias("root"))


def extended(linked: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` after further links, from the roots that they join alone."""
    known = _maybe_broadcast(linked)
    for end in "ab":
        links = links.join(known.select(F.col("class").alias(end), F.col("root").alias("r")),
                           end, "left").withColumn(end, F.coalesce("r", end)).drop("r")
    step = components(links.where("a <> b"))
    moved = _maybe_broadcast(
        step.select(F.col("class").alias("root"), F.col("root").alias("to")))
    return linked.join(moved, "root", "left").select(
        "class", F.coalesce("to", "root").alias("root")).unionByName(step)


def near_classes(documents: DataFrame, signed: DataFrame) -> DataFrame:
    """(class, root) of every class that has a link; ``signed`` is written already."""
    one = signed.where("n_shingles > 0").groupBy("class").agg(
        F.min(F.struct("doc_id", "doc")).alias("r"), F.first("bands").alias("bands"))
    classes = materialize(one.select("class", "r.*", "bands"), "classes")
    marks = classes.select("class", F.explode("bands").alias("bucket"))
    common = materialize(marks.groupBy("bucket").agg(F.count("*").alias("size"))
                         .where("size > 1").select("bucket"), "buckets")
    drawn = materialize(_among(marks, "bucket", common), "drawn")

    # Full sets of the classes that share a bucket, made from one document of each.
    wanted = drawn.select("class").distinct().join(
        classes.select("class", F.col("doc_id").alias("_id"), F.col("doc").alias("_doc")), "class")
    wanted = materialize(wanted, "wanted")
    texts = documents.join(_maybe_broadcast(wanted), F.col("doc").eqNullSafe(F.col("_doc"))
                           & F.col("doc_id").eqNullSafe(F.col("_id"))).select("class", "text")
    sets = materialize(texts.mapInArrow(
        _write_sets, "class binary, low long, high long, set binary, bits array<long>"
    ).dropDuplicates(["class"]),
        "sets", "lz4")
    sizes = materialize(shared_sizes(sets).where(
        DENOMINATOR * F.col("shared") >= NUMERATOR * F.col("n")), "sizes")
    members = drawn.join(_maybe_broadcast(sizes), "class")
    top = members.groupBy("bucket").agg(
        F.max(F.struct("shared", "class", "n")).alias("top"), F.count("*").alias("size")
    ).where("size > 1").select("bucket", F.col("top.class").alias("centre"),
                               F.col("top.shared").alias("shared_b"), F.col("top.n").alias("n_b"))
    members = materialize(members.withColumnsRenamed({"n": "n_a", "shared": "shared_a"}).join(
        _maybe_broadcast(materialize(top, "centres")), "bucket"), "members")

    first = members.where("class <> centre").where(_may_link()).select(
        F.col("class").alias("a"), F.col("centre").alias("b")).distinct()
    tested = materialize(first, "pairs")
    edges = materialize(confirm(tested, sets), "links")
    linked = components(edges)
    members = members.select("bucket", "class", "centre", "n_a", "shared_a")
    bits = sets.select("class", F.struct(*(F.col("bits")[i].alias(f"b{i}")
                                           for i in range(LONGS))).alias("bits"))
    bits = _maybe_broadcast(bits)
    # Members outside their centre's component get a fixed turn as centres.
    main = _maybe_broadcast(
        linked.select(F.col("class").alias("centre"), F.col("root").alias("main")))
    outside = members.join(_maybe_broadcast(linked), "class", "left").join(
        main, "centre", "left").where(
            F.coalesce("root", "class") != F.coalesce("main", "centre")).select(
                "bucket", F.col("class").alias("a"), "n_a", "shared_a")
    outside = materialize(outside, "outside")
    # The one with most shared shingles first, the others in hashed order; every member
    # has its place without its bucket being sorted in one task.
    firsts = materialize(outside.groupBy("bucket").agg(
        F.count("*").alias("size"), F.max(F.struct("shared_a", "a")).alias("first")), "firsts")
    place = F.pmod(F.xxhash64("bucket", "a"), F.col("size")) + 1
    waiting = materialize(outside.join(_maybe_broadcast(firsts), "bucket").join(
        bits.withColumnRenamed("class", "a"), "a").select(
            "bucket", "a", "n_a", "shared_a", F.col("bits").alias("bits_a"),
            F.when(F.col("a") == F.col("first.a"), 0)
            .otherwise(1 + F.floor(F.log(place + 0.5) / math.log(GROWTH)))
            .cast("int").alias("turn")), "waiting")
    # What they are compared with: all members of their buckets, one row for each member
    # with its buckets (at most BANDS).
    others = members.join(_maybe_broadcast(firsts.select("bucket")), "bucket").groupBy(
        "class").agg(F.collect_list("bucket").alias("buckets"), F.first("n_a").alias("n_b"),
                     F.first("shared_a").alias("shared_b"))
    others = materialize(others.join(bits, "class").select(
        "buckets", F.col("class").alias("b"), "n_b", "shared_b",
        F.col("bits").alias("bits_b")), "others")
    last = waiting.agg(F.max("turn")).first()[0]
    for turn in range(0 if last is None else last + 1):
        roots_a, roots_b = (_maybe_broadcast(linked.select(
            F.col("class").alias(c), F.col("root").alias(f"root_{c}"))) for c in "ab")
        now = materialize(waiting.where(F.col("turn") == turn).join(roots_a, "a", "left")
                          .withColumn("root_a", F.coalesce("root_a", "a")), "now")
        pairs = others.join(roots_b, "b", "left").withColumn(
            "root_b", F.coalesce("root_b", "b")).withColumn(
                "bucket", F.explode("buckets")).join(_maybe_broadcast(now), "bucket").where(
                (F.col("root_a") != F.col("root_b")) & _may_link() & _bits_may_link())
        pairs = pairs.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")
                             ).distinct()
        known = tested.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
        pairs = materialize(pairs.join(_maybe_broadcast(known), ["x", "y"], "left_anti").select(
            F.col("x").alias("a"), F.col("y").alias("b")), "pairs")
        if pairs.isEmpty():
            continue
        tested = tested.unionByName(pairs)
        more = materialize(confirm(pairs, sets), "links")
        if not more.isEmpty():
            linked = materialize(extended(linked, more), "linked")
    return linked


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Per document: n_shingles, component_id (least doc_id reachable), kept.

    Null and empty texts have no shingles and link with nothing. A row without words
    is its own component. Rows with equal id and text give equal rows, one per row. A
    null doc_id is never the least of a component that has another id.
    """
    short_batches(documents.sparkSession)
    documents = with_hash(documents.select("doc_id", "text"))
    signed = materialize(sign(documents), "signed")
    linked = near_classes(documents, signed)
    roots = materialize(signed.where("n_shingles > 0").groupBy("class").agg(
        F.min("doc_id").alias("least")).join(_maybe_broadcast(linked), "class", "left").select(
            "class", "least", F.coalesce("root", "class").alias("root")), "roots")
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = materialize(roots.join(least, "root").select("class", "component_id"), "by-class")
    found = signed.select("doc_id", "doc", "n_shingles", "class").join(by_class, "class", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.col("doc_id").eqNullSafe(component).alias("kept"), "doc")


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """One document of each near-duplicate group: that of the least id.

    Repeats of a kept id with equal text are reduced to one row; documents without
    words are all kept.
    """
    found = materialize(near_duplicates(documents), "decided")
    words = F.col("n_shingles") > 0
    dropped = materialize(found.where(words & ~F.col("kept")).select(
        F.col("doc_id").alias("_id"), F.col("doc").alias("_doc")).distinct(), "dropped")
    repeated = materialize(found.where(words & F.col("kept")).groupBy(
        F.col("doc_id").alias("_id"), F.col("doc").alias("_doc")).count()
        .where("count > 1").select("_id", "_doc"), "repeated")
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (own == F.col("_doc"))
    dropped, repeated = _maybe_broadcast(dropped), _maybe_broadcast(repeated)
    once = documents.join(repeated, same).dropDuplicates(["_id", "_doc"]).select(
        *documents.columns)
    rest = documents.join(dropped, same, "left_anti").join(repeated, same, "left_anti")
    return rest.unionByName(once)
