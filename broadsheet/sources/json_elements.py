"""JSON arrays of objects, each file read by as many tasks as it has splits.

Spark's own reader takes one task for a file that is one array. Here the file is read as
text cut at closing braces, which splits at any byte. Where an object starts can't be seen
from inside a split, as a brace may stand in a string; but a split's effect on the reader's
state is small: whether it changes in-string to outside, and how far it opens or closes
braces when it starts outside or inside a string. So

1. one pass sums that effect up for each split;
2. running sums over the splits of a file give the state in which each one starts;
3. a second pass cuts the objects out. Objects across borders leave a part in each split,
   at most two a split, which are put together afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

CUT = "}"
QUOTE, ESCAPE, OPEN, CLOSE = b'"\\{}'
KEY = ["path", "split"]


def _structure(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each byte whether it is in a string, and what a brace there adds to the depth."""
    place = np.arange(len(data))
    plain = np.maximum.accumulate(np.where(data != ESCAPE, place, -1))
    escaped = np.zeros(len(data), bool)
    escaped[1:] = (place - plain)[:-1] % 2 == 1
    quotes = np.cumsum((data == QUOTE) & ~escaped) + inside
    return quotes % 2 == 1, (data == OPEN).astype(np.int64) - (data == CLOSE)


def _pieces(batches):
    """(row of the split, bytes) for runs of rows of one split; rows are in file order."""
    for batch in batches:
        split = batch.column("split").to_numpy()
        path = batch.column("path").dictionary_encode().indices.to_numpy()
        edges = np.flatnonzero((np.diff(split) != 0) | (np.diff(path) != 0)) + 1
        edges = [0, *edges.tolist(), len(batch)]
        for a, b in zip(edges, edges[1:]):
            if a < b:
                part = batch.slice(a, b - a)
                text = CUT.join([*part.column("value").to_pylist(), ""])
                yield part.slice(0, 1), np.frombuffer(text.encode(), np.uint8)


def _effects(batches):
    """One row a split: change of the in-string state, depth gained from either state."""
    held: dict[tuple, list[int]] = {}
    for head, data in _pieces(batches):
        key = (head.column("path")[0].as_py(), head.column("split")[0].as_py())
        sums = held.setdefault(key, [0, 0, 0])
        inside, depth = _structure(data, bool(sums[0]))
        sums[1] += int(depth[~inside].sum())
        sums[2] += int(depth[inside].sum())
        quotes = _ends_inside(data, inside)
        sums[0] = int(quotes)
    keys = list(held)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()),
         *(pa.array([held[k][i] for k in keys], pa.int64()) for i in range(3))],
        [*KEY, "flips", "outside", "inside"])


def _ends_inside(data: np.ndarray, inside: np.ndarray) -> bool:
    # The last byte is a brace, so the state behind it is its own.
    return bool(inside[-1]) if len(data) else False


def _cut(batches):
    """Objects and parts of objects, with whether their start and their end are there."""
    key, parts, depth, opened, inside = None, [], 0, True, False

    def row(closed):
        value = b"".join(parts).decode()
        parts.clear()
        return (*key, value, opened, closed)
    rows = []
    for head, data in _pieces(batches):
        now = (head.column("path")[0].as_py(), head.column("split")[0].as_py())
        if now != key:
            if parts:
                rows.append(row(False))
            key, opened = now, False
            inside = head.column("in_string")[0].as_py()
            depth = head.column("depth")[0].as_py()
        in_string, change = _structure(data, inside)
        change[in_string] = 0
        level = depth + np.cumsum(change)
        starts = np.flatnonzero((change == 1) & (level == 1))
        ends = np.flatnonzero((change == -1) & (level == 0)) + 1
        raw, at = data.tobytes(), 0
        if depth > 0:
            end = int(ends[0]) if len(ends) else len(raw)
            parts.append(raw[:end])
            if len(ends):
                rows.append(row(True))
                opened, ends = True, ends[1:]
        opened = opened or bool(len(starts))
        for at, end in zip(starts.tolist(), ends.tolist()):
            parts.append(raw[at:end])
            rows.append(row(True))
        if len(starts) > len(ends):
            parts.append(raw[int(starts[-1]):])
        inside = _ends_inside(data, in_string)
        depth = int(level[-1]) if len(level) else depth
        if len(rows) >= 1000:
            yield _batch(rows)
            rows = []
    if parts:
        rows.append(row(False))
    yield _batch(rows)


def _batch(rows) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
        [*KEY, "value", "opened", "closed"])


def read_json_objects(spark: SparkSession, path) -> DataFrame:
    """``value``: the text of every outermost object of the files, in no order.

    A file may be an array of objects, one object, or objects side by side, in UTF-8. What
    stands outside of objects is skipped; an object that never ends comes as it is.
    """
    rows = spark.read.option("lineSep", CUT).text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split"), "value")
    effects = rows.mapInArrow(
        _effects, "path string, split long, flips long, outside long, inside long")
    before = Window.partitionBy("path").orderBy("split").rowsBetween(
        Window.unboundedPreceding, -1)
    inside = (F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2 == 1)
    gained = F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))
    states = effects.withColumn("in_string", inside).withColumn("gained", gained).withColumn(
        "depth", F.coalesce(F.sum("gained").over(before), F.lit(0)))
    # One short row for each split of the input; the rows keep their order in this join.
    states = F.broadcast(states.select(*KEY, "in_string", "depth"))
    cut = rows.join(states, KEY).mapInArrow(
        _cut, "path string, split long, value string, opened boolean, closed boolean")
    whole = F.col("opened") & F.col("closed")
    upto = Window.partitionBy("path").orderBy("split", "opened")
    parts = cut.where(~whole).withColumn("owner", F.last(
        F.when(F.col("opened"), F.col("split")), ignorenulls=True).over(upto))
    # An object's own parts, one or two a split.
    joined = parts.groupBy("path", "owner").agg(F.array_sort(F.collect_list(
        F.struct("split", "value"))).alias("parts")).select(
            F.array_join("parts.value", "").alias("value"))
    return cut.where(whole).select("value").unionByName(joined)


def read_json_elements(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """The objects as rows of ``schema``, like Spark's reader for one array a file."""
    parsed = F.from_json("value", schema)
    return read_json_objects(spark, path).select(parsed.alias("r")).select("r.*")
