"""Packing documents into sequences of fixed capacity by linear grouping.

1. Every document is encoded whole, gets the end id and, if longer than a sequence, is cut
   so that only its first piece is shorter. A map gives each piece its length and its rank
   among the pieces of that length, so from here on a piece is a length and a rank.
2. The plan needs only how many pieces each length has, one number for each of
   ``capacity`` lengths however large the corpus. Large lengths are put into groups of
   equal cardinality and rounded up to the longest of the group. The configurations of the
   few rounded sizes come from the linear programme of the cutting-stock problem, solved
   by column generation, and are rounded down to whole numbers.
3. The actual pieces take the places of the rounded sizes, rank by rank. What the rounding
   left over and the small pieces fill the gaps by best fit, longest first, all pieces of
   one length at a time.
4. The plan is a list of runs of consecutive ranks that go to consecutive sequences. Each
   piece looks its place up in it, in its own row; no piece is shuffled or collected.

The list of runs is bounded by the capacity, not by the corpus, so it is sent to the tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from broadsheet.llm import byte_bpe
from broadsheet.llm.storage import materialize

CAPACITY = 1024
END_ID = 2
GROUPS = 256            # groups of equal cardinality
SMALL = 4               # a piece of up to a SMALL-th of the capacity is small
GAP = 1e-4              # of the linear programme to its bound, as a share
STEPS = 24              # of column generation for each size, at most
BROADCAST_ROWS = 1_000_000
ROWS = 4096


# --- 1. Pieces ------------------------------------------------------------------

def _cut(path: str, capacity: int, keep_ids: bool):
    def run(batches):
        encoder = byte_bpe.encoder(path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        rows: list[tuple] = []

        def flush():
            length = np.array([r[3] for r in rows], np.int64)
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            heads = np.searchsorted(ordered, ordered)
            rank = np.empty(len(rows), np.int64)
            rank[order] = np.arange(len(rows)) - heads + seen[ordered]
            np.add.at(seen, length, 1)
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(
                (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array([r[5] for r in rows], pa.binary()))
                names.append("ids")
            columns += [pa.array(np.full(len(rows), task, np.int32)), pa.array(rank)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, [*names, "task", "rank"])
        for batch in batches:
            coded = encoder.encode_rows(batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coded):
                ids = np.append(ids, END_ID).astype("<u4")
                first = len(ids) % capacity
                edges = [*([0] if first else []), *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                    raw = ids[a:b].tobytes()
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(raw),
                                 raw if keep_ids else None))
                if len(rows) >= ROWS:
                    yield flush()
        if rows:
            yield flush()
    return run


def cut_documents(documents: DataFrame, path: str, capacity: int = CAPACITY,
                  keep_ids: bool = False) -> DataFrame:
    """The pieces of every document, with their rank among those of one length and task.

    A null or empty text is the end id alone. ``keep_ids`` adds the ids as little-endian
    unsigned 32-bit integers.
    """
    schema = ("doc_id long, piece int, start long, length long, ids_crc32 long, "
              + ("ids binary, " if keep_ids else "") + "task int, rank long")
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _cut(path, capacity, keep_ids), schema)


# --- 2. Configurations ----------------------------------------------------------

def linear_groups(counts: np.ndarray, groups: int) -> list[tuple[int, int, int]]:
    """(rounded size, first, end) of each group, in ranks from the longest piece on.

    ``counts`` has the number of pieces by length; groups of one rounded size are one.
    """
    total = int(counts.sum())
    ends = np.cumsum(counts[::-1])
    out: list[tuple[int, int, int]] = []
    for g in range(groups):
        first, end = total * g // groups, total * (g + 1) // groups
        if first == end:
            continue
        size = len(counts) - 1 - int(np.searchsorted(ends, first, "right"))
        if out and out[-1][0] == size:
            out[-1] = (size, out[-1][1], end)
        else:
            out.append((size, first, end))
    return out


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int):
    """The most valuable content of one sequence, and its worth (knapsack by item count)."""
    useful = np.flatnonzero(worth > 1e-12)
    if not len(useful):
        return np.zeros(len(sizes)), 0.0
    w, v = sizes[useful], worth[useful]
    value, picks = np.zeros(capacity + 1), []
    at = np.arange(capacity + 1)[:, None] - w[None, :]
    for _ in range(capacity // int(w.min())):
        held = np.where(at >= 0, value[np.maximum(at, 0)] + v, -1.0)
        best = held.argmax(axis=1)
        gain = held[np.arange(capacity + 1), best]
        better = gain > value + 1e-15
        picks.append(np.where(better, best, -1))
        if not better.any():
            break
        value = np.where(better, gain, value)
    pattern, room = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if pick[room] >= 0:
            pattern[useful[pick[room]]] += 1
            room -= int(w[pick[room]])
    return pattern, float(value[capacity])


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By elimination; ``numpy.linalg.inv`` did not return in a driver beside the JVM."""
    many = len(matrix)
    both = np.hstack([matrix.astype(float), np.eye(many)])
    for k in range(many):
        row = k + int(np.abs(both[k:, k]).argmax())
        both[[k, row]] = both[[row, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0.0
        both -= factor[:, None] * both[k]
    return both[:, many:]


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int
                   ) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often to use each, from the cutting-stock programme.

    Every step holds a solution, so stopping early costs sequences, never correctness. It
    ends when the bound of the duals leaves less than a quarter of a sequence, or ``GAP``.
    """
    many = len(sizes)
    fit = capacity // sizes
    basis, inverse = np.diag(fit.astype(float)), np.diag(1.0 / fit)
    # Slightly unequal demands, as equal ones would let the steps go in circles.
    demand = demand + 1e-6 * (1 + np.arange(many)) / many
    used = demand / fit
    for step in range(STEPS * many):
        worth = inverse.sum(axis=0)
        pattern, value = _best_pattern(sizes, worth, capacity)
        if value <= 1 + max(GAP, 0.25 / used.sum()):
            break
        along = sum(pattern[g] * inverse[:, g] for g in np.flatnonzero(pattern))
        grows = along > 1e-10
        ratio = np.where(grows, used / np.where(grows, along, 1.0), np.inf)
        out = int(ratio.argmin())
        used = np.maximum(used - ratio[out] * along, 0.0)
        used[out] = ratio[out]
        basis[:, out] = pattern
        pivot = inverse[out] / along[out]
        inverse -= along[:, None] * pivot
        inverse[out] = pivot
        if step % 256 == 255:
            inverse = _inverse(basis)
            used = np.maximum((inverse * demand).sum(axis=1), 0.0)
    return basis.astype(int), used


# --- 3. The plan ----------------------------------------------------------------

class _Plan:
    """Runs of ranks and the room left in the sequences, as ranges of sequences."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.rooms: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []      # rooms in ascending order

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def place(self, length, rank, count, sequence, per_sequence, offset) -> None:
        self.runs.append((length, rank, count, sequence, per_sequence, offset))

    def leave(self, room: int, sequence: int, count: int) -> None:
        if room and count:
            if room not in self.rooms:
                insort(self.sizes, room)
            self.rooms.setdefault(room, []).append((sequence, count))

    def best_fit(self, length: int, rank: int, count: int) -> None:
        """Pieces of one length, one after the other, each into the least room that holds it.

        The fullest sequence stays the best fit until it is full, so it takes as many as
        go into it before the next one is looked at.
        """
        while count:
            at = bisect_left(self.sizes, length)
            if at == len(self.sizes):
                room, per = self.capacity, self.capacity // length
                spans = [(self.open(-(-count // per)), -(-count // per))]
            else:
                room = self.sizes.pop(at)
                per, spans = room // length, self.rooms.pop(room)
            for nth, (sequence, many) in enumerate(spans):
                full = min(many, count // per)
                rest = count - full * per if full < many else 0
                took = full * per + rest
                self.place(length, rank, took, sequence, per, self.capacity - room)
                self.leave(room - per * length, sequence, full)
                if rest:
                    self.leave(room - rest * length, sequence + full, 1)
                rank, count = rank + took, count - took
                if not count:
                    self.leave(room, sequence + full + bool(rest), many - full - bool(rest))
                    for span in spans[nth + 1:]:
                        self.leave(room, *span)
                    break


def plan_runs(counts: np.ndarray, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, pieces, sequence, per sequence, offset); sequences used.

    ``counts[n]`` is the number of pieces of length n, up to the capacity.
    """
    counts = np.asarray(counts, np.int64)
    capacity = len(counts) - 1
    plan = _Plan(capacity)
    full = int(counts[capacity])
    if full:
        plan.place(capacity, 0, full, plan.open(full), 1, 0)
    large = counts.copy()
    large[capacity] = 0
    large[:capacity // SMALL + 1] = 0
    ends = np.cumsum(large[::-1])           # pieces of at least a length, longest first

    def spans(first: int, end: int):
        """Ranks from the longest on as (length, rank within the length, count)."""
        while first < end:
            back = int(np.searchsorted(ends, first, "right"))
            length, upto = capacity - back, min(end, int(ends[back]))
            yield length, first - int(ends[back] - large[length]), upto - first
            first = upto
    grouped = linear_groups(large, groups)
    if grouped:
        sizes = np.array([g[0] for g in grouped])
        demand = np.array([g[2] - g[1] for g in grouped], float)
        patterns, used = configurations(sizes, demand, capacity)
        taken = [g[1] for g in grouped]
        for column, wanted in zip(patterns.T, np.floor(used + 1e-9).astype(int).tolist()):
            inside = [g for g in np.flatnonzero(column) for _ in range(column[g])]
            # Rounded figures must not ask for more than a group has.
            wanted = min([wanted, *((grouped[g][2] - taken[g]) // int(column[g])
                                    for g in set(inside))])
            if wanted <= 0:
                continue
            slots = []
            for g in inside:
                slots.append(list(spans(taken[g], taken[g] + wanted)))
                taken[g] += wanted
            _substitute(plan, slots, wanted)
        left = [s for g, (_, _, end) in enumerate(grouped) for s in spans(taken[g], end)]
    else:
        left = []
    for length, rank, count in left:
        plan.best_fit(length, rank, count)
    for length in range(capacity // SMALL, 0, -1):
        plan.best_fit(length, 0, int(counts[length]))
    runs = np.array(plan.runs, np.int64).reshape(-1, 6)
    return runs[np.lexsort((runs[:, 1], runs[:, 0]))], plan.sequences


def _substitute(plan: _Plan, slots: list[list[tuple[int, int, int]]], wanted: int) -> None:
    """Actual pieces into ``wanted`` sequences of one configuration, slot by slot."""
    first = plan.open(wanted)
    edges = sorted({0, wanted, *(int(e) for slot in slots
                                 for e in np.cumsum([s[2] for s in slot]))})
    places = [[0, 0] for _ in slots]        # span of the slot, pieces of it that are used
    for a, b in zip(edges, edges[1:]):
        offset = 0
        for slot, place in zip(slots, places):
            length, rank, count = slot[place[0]]
            plan.place(length, rank + place[1], b - a, first + a, 1, offset)
            offset += length
            place[1] += b - a
            if place[1] == count:
                place[:] = [place[0] + 1, 0]
        plan.leave(plan.capacity - offset, first + a, b - a)


# --- 4. Places ------------------------------------------------------------------

def _place(runs: np.ndarray):
    def run(batches):
        heads = runs[:, 0] << 44 | runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(heads, length << 44 | rank, "right") - 1
            _, first, _, sequence, per, offset = runs[at].T
            nth = rank - first
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(sequence + nth // per),
                 pa.array(offset + nth % per * length)],
                [*kept.schema.names, "sequence_id", "offset"])
    return run


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY,
                 groups: int = GROUPS) -> DataFrame:
    """``sequence_id`` and ``offset`` for written pieces of ``cut_documents``."""
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("pieces"))
    counts = materialize(counts, "piece-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, many in counts.groupBy("length").agg(F.sum("pieces")).collect():
        histogram[length] = many
    runs, _ = plan_runs(histogram, groups)
    before = counts.select("task", "length", F.coalesce(F.sum("pieces").over(
        Window.partitionBy("length").orderBy("task").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    if counts.count() <= BROADCAST_ROWS:
        before = F.broadcast(before)
    ranked = pieces.join(before, ["task", "length"]).withColumn(
        "rank", F.col("rank") + F.col("before")).select(
            *(c for c in pieces.columns if c != "task"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}"
                       for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(_place(runs), f"{fields}, sequence_id long, offset long")


def pack_documents(documents: DataFrame, path: str, capacity: int = CAPACITY,
                   keep_ids: bool = False) -> DataFrame:
    """One row per piece: where it comes from, its length, its sequence and place there.

    doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset. Repeated rows are
    packed as often as they occur; a null id stays null; an empty table gives no row.
    """
    pieces = materialize(cut_documents(documents, path, capacity, keep_ids), "pieces")
    return place_pieces(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, ids, doc_ids in order.

    ``packed`` has ``ids``. A sequence holds at most ``capacity`` pieces, so its group is
    bounded.
    """
    piece = F.struct("offset", "doc_id", "length", "ids")
    held = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return held.select(
        "sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda n, p: n + p["length"])
        .alias("n_tokens"),
        F.aggregate("p", F.lit(b""), lambda raw, p: F.concat(raw, p["ids"])).alias("ids"),
        F.col("p.doc_id").alias("doc_ids"))
