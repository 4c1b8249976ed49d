"""Word shingles of whole Arrow batches with numpy, and their one-permutation hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

WORDS = 5
# Bytes handled at once, unless one text is longer.
SLICE_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + 1
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown on demand."""
    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int):
        if len(cls.up) < n:
            n = 1 << (n - 1).bit_length()
            cls.up, cls.down = (np.multiply.accumulate(np.concatenate(
                [np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))
                for base in (_BASE, pow(_BASE, -1, 1 << 64)))
        return cls.up, cls.down


def text_slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of a text column: (first row, bytes, offsets of its rows)."""
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


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased), and the offsets of rows in words."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    fresh = np.ones(len(data) + 1, bool)
    fresh[1:-1] = space[:-1]
    fresh[offsets] = True
    starts = np.flatnonzero(~space & fresh[:-1])
    last = np.ones(len(data), bool)
    last[:-1] = space[1:]
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(~space & last) + 1
    up, down = _Powers.get(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data] * up[:len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row.

    A row of fewer than ``WORDS`` words has its whole sequence as one shingle; a row
    without words, or null, has none.
    """
    for _, data, offsets in text_slices(texts):
        words, rows = word_hashes(data, offsets)
        n = len(words)
        grams = np.zeros(n, np.uint64)
        for k in range(WORDS):
            grams[:n - k] += words[k:] * _MIX[k]
        grams = mix(grams)
        for a, b in zip(rows[:-1], rows[1:]):
            if b - a >= WORDS:
                yield np.unique(grams[a:b - WORDS + 1])
            elif b > a:
                short = words[a:b] * _MIX[:b - a]
                yield mix(np.array([short.sum() + np.uint64(b - a)], np.uint64) * _MIX[4])
            else:
                yield grams[:0]


@cache
def _probes(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin, the order in which it asks other bins, and each bin's rank in it."""
    random = np.random.default_rng(20171)
    order = np.argsort(random.random((bins, bins)), axis=1)
    return order, np.argsort(order, axis=1)


def one_permutation(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation MinHash with optimal densification; an empty set gives zeros.

    The least hash of each of ``bins`` ranges; an empty bin takes the value of the first
    full bin in an order of bins fixed for it alone.
    """
    out = np.zeros((len(sets), bins), np.uint64)
    full = np.zeros((len(sets), bins), bool)
    for i, values in enumerate(sets):
        if len(values):
            bin_of = ((values >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(int)
            first = np.flatnonzero(np.diff(bin_of, prepend=-1))
            out[i, bin_of[first]] = values[first]
            full[i, bin_of[first]] = True
    order, rank = _probes(bins)
    some = full.any(axis=1)
    row, col = np.nonzero(~full & some[:, None])
    for step in range(16):
        if not len(row):
            break
        ask = order[col, step]
        hit = full[row, ask]
        out[row[hit], col[hit]] = out[row[hit], ask[hit]]
        row, col = row[~hit], col[~hit]
    for i in np.unique(row):
        left, there = col[row == i], np.flatnonzero(full[i])
        out[i, left] = out[i, there[np.argmin(rank[left][:, there], axis=1)]]
    return out


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, different for equal rows of different bands."""
    shaped = signatures.reshape(len(signatures), bands, rows)
    salt = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    return mix((mix(shaped) * salt).sum(axis=2, dtype=np.uint64)
               + mix(np.arange(bands, dtype=np.uint64) + np.uint64(77)))
