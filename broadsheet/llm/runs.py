"""Periodic runs of words by an enhanced suffix array.

A run is a maximal stretch of words with smallest period q that is long enough. For each
document

1. the suffixes are sorted by prefix doubling over word numbers; the ranks of every step
   are kept, and the common prefix of neighbours (LCP) is read off them from the longest
   step down;
2. every entry of the LCP array is the border of two neighbouring parts of its LCP interval,
   whose edges are the next smaller entries on both sides. Each suffix i of the smaller part
   is tested: if the rank (ISA) of i + depth or i - depth lies in the other part, the text
   has a branching square there, a word string of length depth twice that cannot be
   shifted to the right. So each suffix is tested at most log n times;
3. a branching square is the end of exactly one run. Squares are rotated to the left as
   long as words agree, which gives the start; of those that end at one place, multiples
   of a shorter period are merged into its run.

All documents of a slice are handled at once with numpy; word numbers of different documents
differ, so nothing matches across documents. No tree nodes are made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORTEST, EXPONENT = 24, 3
SLICE_BYTES = 1 << 20       # unless one text is longer
TESTS = 1 << 20             # suffixes tested at once

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
RUN = "array<struct<start:long,length:long,period:long>>"


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of UTF-8 rows, and the borders of the rows in words."""
    inside = ~_BLANK[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | fresh[1:-1]
    starts = np.flatnonzero(first)
    kept = np.concatenate([[0], np.cumsum(inside)])
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(kept[starts], kept[-1])),
                                         pa.py_buffer(data[inside])])
    return words, np.searchsorted(starts, offsets)


def _rank(first: np.ndarray, second: np.ndarray | None = None):
    """Order by (first, second), and whether each is the head of a group of equals."""
    if second is None:
        order = np.argsort(first, kind="stable")
    else:
        order = np.lexsort((second, first))
    head = np.ones(len(order), bool)
    head[1:] = first[order[1:]] != first[order[:-1]]
    if second is not None:
        head[1:] |= second[order[1:]] != second[order[:-1]]
    return order, head


def suffix_arrays(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, its inverse and LCP of ``words``.

    Equal numbers must not occur in different documents. ``lcp[k]`` is of ``sa[k - 1]`` and
    ``sa[k]``; ``lcp[0]`` is 0.
    """
    n = len(words)
    sa, head = _rank(words)
    place = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.full(n + 1, -1, np.int64)     # the end of all texts is before every word
    rank[sa] = place
    levels = [rank.copy()]
    step = 1
    alone = head & np.append(head[1:], True)
    open_ = np.flatnonzero(~alone)          # places in groups of several
    while len(open_):
        at = sa[open_]
        second = rank[np.minimum(at + step, n)]
        order, head = _rank(rank[at], second)
        sa[open_] = at[order]
        place = np.maximum.accumulate(np.where(head, open_, 0))
        rank[sa[open_]] = place
        open_ = open_[~(head & np.append(head[1:], True))]
        levels.append(rank.copy())
        step *= 2
    a, b = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(n, np.int64)
    # No two suffixes agree in the last level, so its lengths need no test.
    live = np.flatnonzero(levels[0][a] == levels[0][b]) if n > 1 else np.zeros(0, np.int64)
    a, b = a[live], b[live]
    same = np.zeros(len(live), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        equal = levels[k][a] == levels[k][b]
        same += equal << k
        a, b = a + (equal << k), b + (equal << k)
    lcp[live + 1] = same
    return sa, rank, lcp


def _next_smaller(values: np.ndarray, places: np.ndarray, strict: bool) -> np.ndarray:
    """For each place the first later one with a smaller (or, not strict, equal) value.

    ``values`` ends with one below all others. Minima over spans of powers of two are
    walked up until a span holds a smaller value, then down into it, for all places at once.
    """
    n = len(values)
    spans = [values]
    at = places + 1
    live = np.arange(len(places))
    passed = []

    def free(level, which):
        """Whether the span of a level from where each place stands can be passed."""
        start = at[which]
        least = spans[level][np.minimum(start, len(spans[level]) - 1)]
        own = values[places[which]]
        return ((least >= own) if strict else (least > own)) & (start + (1 << level) <= n)
    while len(live) and len(spans[-1]) > 0:
        level = len(passed)
        live = live[free(level, live)]
        at[live] += 1 << level
        passed.append(live)
        if len(spans[-1]) <= 1 << level:
            break
        spans.append(np.minimum(spans[-1][:-(1 << level)], spans[-1][1 << level:]))
    for level in range(len(passed) - 1, -1, -1):
        which = passed[level]
        ok = which[free(level, which)]
        at[ok] += 1 << level
    return at


def branching_squares(sa, isa, lcp) -> tuple[np.ndarray, np.ndarray]:
    """(start, depth) of every branching square, once or more."""
    n = len(sa)
    # Blocks without shared first words need no look; a 0 between them keeps them apart.
    border = np.flatnonzero(lcp > 0)
    if not len(border):
        return border, border
    right = _next_smaller(np.append(lcp, -1), border, strict=True)
    left = n - 1 - _next_smaller(np.append(lcp[::-1], -1), n - 1 - border, strict=False)
    depth = lcp[border]
    # Suffixes left .. border - 1 on one side, border .. right - 1 on the other.
    smaller_left = border - left <= right - border
    low = np.where(smaller_left, left, border)
    count = np.where(smaller_left, border - left, right - border)
    other_low = np.where(smaller_left, border, left)
    other_end = np.where(smaller_left, right, border)
    starts, depths = [], []
    upto = np.concatenate([[0], np.cumsum(count)])
    first = 0
    while first < len(border):
        end = max(first + 1, int(np.searchsorted(upto, upto[first] + TESTS, "right")) - 1)
        many = count[first:end]
        of = np.repeat(np.arange(first, end), many)
        suffix = sa[np.arange(upto[end] - upto[first]) - np.repeat(
            upto[first:end] - upto[first], many) + low[of]]
        d = depth[of]
        for start, mate in ((suffix, suffix + d), (suffix - d, suffix - d)):
            ok = np.flatnonzero((mate >= 0) & (mate < n))
            at = isa[mate[ok]]
            ok = ok[(at >= other_low[of[ok]]) & (at < other_end[of[ok]])]
            starts.append(start[ok])
            depths.append(d[ok])
        first = end
    return np.concatenate(starts), np.concatenate(depths)


def _rotate(words: np.ndarray, start: int, period: int, first: int) -> int:
    """How far left a square can be shifted, at least to ``first``."""
    step = 64
    while start > first:
        low = max(first, start - step)
        differ = np.flatnonzero(words[low:start] != words[low + period:start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, step = low, 4 * step
    return start


def find_runs(words: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, by document, start and period.

    ``borders`` are those of the documents in ``words``; equal words of different
    documents have different numbers.
    """
    if len(words) < SHORTEST:
        return np.zeros((0, 4), np.int64)
    start, period = branching_squares(*suffix_arrays(words))
    # A run has one period more to the left of its last square, and SHORTEST words in all.
    need = np.maximum((EXPONENT - 2) * period, SHORTEST - 2 * period)
    document = np.searchsorted(borders, start, "right") - 1
    live = np.flatnonzero(start - need >= borders[document])
    for back in range(1, 1 + max(SHORTEST, 1)):
        at = start[live] - back
        live = live[(back > need[live])
                    | (words[np.maximum(at, 0)] == words[np.maximum(at, 0) + period[live]])]
    squares = np.unique(np.stack([document[live], start[live] + 2 * period[live],
                                  period[live]], axis=1), axis=0)
    out, at = [], 0
    while at < len(squares):
        # All squares that end at one place, the shortest period first.
        doc, end, _ = squares[at]
        upto = at
        found: list[tuple[int, int]] = []
        while upto < len(squares) and squares[upto, 0] == doc and squares[upto, 1] == end:
            p = int(squares[upto, 2])
            upto += 1
            if any(p % q == 0 and 2 * p <= end - s for s, q in found):
                continue
            s = _rotate(words, int(end) - 2 * p, p, int(borders[doc]))
            found.append((s, p))
            if end - s >= max(SHORTEST, EXPONENT * p):
                out.append((doc, s - borders[doc], end - s, p))
        at = upto
    rows = np.array(out, np.int64).reshape(-1, 4)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def dropped_words(runs: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Which words some run holds after its first period."""
    change = np.zeros(int(borders[-1]) + 1, np.int64)
    document, start, length, period = runs.T
    np.add.at(change, borders[document] + start + period, 1)
    np.add.at(change, borders[document] + start + length, -1)
    return np.cumsum(change)[:-1] > 0


def _slices(texts: pa.Array):
    """(first row, bytes, offsets of the rows) of bounded pieces of a text column."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[
        texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def _collapse(batches):
    for batch in batches:
        for row, data, offsets in _slices(batch.column("text")):
            words, borders = split_words(data, offsets)
            number = words.dictionary_encode().indices.to_numpy(
                zero_copy_only=False).astype(np.int64)
            document = np.repeat(np.arange(len(offsets) - 1), np.diff(borders))
            runs = find_runs(document * (int(number.max(initial=0)) + 1) + number, borders)
            kept = ~dropped_words(runs, borders)
            upto = np.concatenate([[0], np.cumsum(kept)])[borders]
            texts = _joined(words if kept.all() else words.filter(pa.array(kept)), upto)
            held = np.searchsorted(runs[:, 0], np.arange(len(offsets))).astype(np.int32)
            items = pa.StructArray.from_arrays(
                [pa.array(np.ascontiguousarray(runs[:, i])) for i in (1, 2, 3)],
                ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(row, len(offsets) - 1),
                 pa.array(np.diff(borders)),
                 pa.ListArray.from_arrays(pa.array(held), items), texts],
                ["doc_id", "n_words", "runs", "collapsed"])


def _joined(words: pa.Array, borders: np.ndarray) -> pa.Array:
    """The words of each row with one space between them."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[
        words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    # Every word but the last of its row gets a space behind it.
    spaced = np.ones(len(words), bool)
    spaced[borders[1:][np.diff(borders) > 0] - 1] = False
    ends = offsets[1:] + np.cumsum(spaced)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    letters = np.ones(len(out), bool)
    letters[ends[spaced] - 1] = False
    out[letters] = data
    edges = np.concatenate([[0], ends])[borders]
    return pa.LargeStringArray.from_buffers(
        len(borders) - 1, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(out)
    ).cast(pa.string())


def collapse_runs(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period), collapsed.

    ``runs`` has every stretch of words with smallest period q of at least max(24, 3 q)
    words that can't be extended; ``collapsed`` is the text without the words that some run
    holds after its first period, words joined by one space. Words are what stands between
    ASCII white space, compared as they are. A null text has no words, like an empty one;
    rows that repeat give equal rows; an empty table gives none.
    """
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _collapse, f"doc_id long, n_words long, runs {RUN}, collapsed string")


def run_digest(collapsed: DataFrame) -> DataFrame:
    """n_runs, the run of greatest exponent, and digests of the runs and of the rest."""
    def less(a, b):
        # By exact exponent: the products compare fractions without rounding.
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(left != right, left > right).when(
            a["start"] != b["start"], a["start"] < b["start"]).otherwise(
                a["period"] < b["period"])
    best = F.aggregate("runs", F.get("runs", F.lit(0)),
                       lambda held, run: F.when(less(run, held), run).otherwise(held))
    lines = F.transform("runs", lambda r: F.concat_ws(
        ",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))
                    ).otherwise("")
    return collapsed.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
