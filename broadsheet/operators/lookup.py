"""Looking words up in lists of any length before rows are multiplied."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAN_TERMS = 500                # a list up to this length is part of the plan
BITS_PER_TERM = 16
MOST_LONGS = 1 << 14            # of the bit table, however long the list
BLOCK_LONGS = 16                # in a row of the larger table, which is sent
MOST_BLOCKS = 1 << 19           # rows of it, however long the list: 64 MB of bits
BITS_SET = 4                    # by a term in it, all in one long
BROADCAST_BYTES = 16 << 20      # of a list that is sent to all executors


def _bit_places(hashed: Column, blocks: int) -> tuple[Column, Column, Column]:
    """The block of a hash, the long in it, and the bits set there."""
    mask = F.lit(0).cast("long")
    for n in range(BITS_SET):
        bit = F.shiftrightunsigned(hashed, 23 + 6 * n).bitwiseAND(63).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return (hashed.bitwiseAND(blocks - 1),
            F.shiftrightunsigned(hashed, 19).bitwiseAND(BLOCK_LONGS - 1).cast("int"), mask)


def _bit_blocks(hashes: DataFrame, blocks: int) -> DataFrame:
    """``_block, _bits`` with the bits of all rows of ``_hash``; at most ``blocks`` rows."""
    block, at, mask = _bit_places(F.col("_hash"), blocks)
    longs = hashes.groupBy((block * BLOCK_LONGS + at).alias("_long")).agg(
        F.bit_or(mask).alias("_set"))
    place = F.col("_long").bitwiseAND(BLOCK_LONGS - 1)
    found = longs.groupBy(F.shiftright("_long", 4).alias("_block")).agg(*[
        F.bit_or(F.when(place == n, F.col("_set"))).alias(f"_{n}")
        for n in range(BLOCK_LONGS)])
    return found.select("_block", F.array(*[
        F.coalesce(F.col(f"_{n}"), F.lit(0).cast("long"))
        for n in range(BLOCK_LONGS)]).alias("_bits"))


def in_bits(rows: DataFrame, listed: DataFrame, on: str, blocks: int) -> DataFrame:
    """The rows that may be in ``listed``, by a table of ``blocks`` KBit that is sent.

    For words of which few are in the list this is quicker than the list itself.
    """
    table = _bit_blocks(listed.select(F.xxhash64(on).alias("_hash")), blocks)
    block, at, mask = _bit_places(F.col("_hash"), blocks)
    asked = rows.where(F.col(on).isNotNull()).withColumn("_hash", F.xxhash64(on)).join(
        F.broadcast(table), F.col("_block") == block)
    return asked.where(F.get("_bits", at).bitwiseAND(mask) == mask).select(*rows.columns)


@dataclass
class Lookup:
    """A list of terms, ready to be asked inside a row and to be joined.

    ``may_hold`` never says no to a term of the list. For a short list it is exact; for a
    longer one it reads a bit table of bounded size, built by partial aggregates, which
    lets a share of other words pass that grows with the list. So only few words of a text
    ever leave its row, and those meet the list itself in ``join``. A list that would fill
    this table has a larger one besides, sent as rows to the words that ``thin`` asks about.
    """
    terms: DataFrame            # (term)
    known: tuple[str, ...] | None
    longs: list[int]
    small: bool
    blocks: int = 0             # of the larger table, a power of two; none for a shorter list

    @classmethod
    def of(cls, terms: DataFrame) -> Lookup:
        """Of a table with ``term``; NULL is no term.

        Terms are made distinct to be counted only where they may be few; else their number
        is estimated, so a long list is not shuffled for it.
        """
        every = terms.select("term").where(F.col("term").isNotNull())
        terms = every.distinct()
        rows, count, size = every.agg(
            F.count("*"), F.approx_count_distinct("term"),
            F.sum(F.octet_length("term") + 16)).first()
        if count <= 4 * PLAN_TERMS:
            count, size = terms.agg(F.count("*"), F.sum(F.octet_length("term") + 16)).first()
        elif rows:
            size = size * min(count, rows) // rows
        small = (size or 0) <= BROADCAST_BYTES
        if count <= PLAN_TERMS and small:
            return cls(terms, tuple(sorted(r.term for r in terms.collect())), [], small)
        longs = 16
        while longs < MOST_LONGS and 64 * longs < BITS_PER_TERM * count:
            longs *= 2
        place = F.pmod(F.xxhash64("term"), F.lit(64 * longs))
        # At most ``longs`` rows; equal terms set the same bit.
        rows = every.groupBy(F.shiftright(place, 6).alias("at")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(pmod(xxhash64(term), "
                            f"{64 * longs}) & 63 AS int))")).alias("bits"))
        table = [0] * longs
        for at, bits in rows.collect():
            table[at] = bits
        if 64 * longs >= BITS_PER_TERM * count:
            return cls(terms, None, table, small)
        blocks = 1
        while blocks < MOST_BLOCKS and 64 * BLOCK_LONGS * blocks < BITS_PER_TERM * count:
            blocks *= 2
        return cls(terms, None, table, small, blocks)

    def may_hold(self, token: Column) -> Column:
        if self.known is not None:
            return token.isin(*self.known) if self.known else F.lit(False)
        place = F.pmod(F.xxhash64(token), F.lit(64 * len(self.longs)))
        table = F.from_json(F.lit(json.dumps(self.longs)), "array<bigint>")
        return F.getbit(F.get(table, F.shiftright(place, 6).cast("int")),
                        place.bitwiseAND(63).cast("int")) == 1

    def thin(self, rows: DataFrame, listed: DataFrame, on: str) -> DataFrame:
        """The rows that may be in ``listed``, which is the list or a part of it.

        Where the list itself is sent, the small table is enough.
        """
        if self.small or not self.blocks:
            return rows.where(self.may_hold(F.col(on)))
        return in_bits(rows, listed, on, self.blocks)

    def join(self, rows: DataFrame, listed: DataFrame, on) -> DataFrame:
        """``rows`` with the list's own table; the list is the side that is sent, if any.

        Without the hint the optimiser, which can't know how few rows are left, may send
        the words of the corpus instead. In a shuffle join each task builds its part of the
        list, of which a term has few rows, so the words of the corpus are not sorted.
        """
        return rows.join(F.broadcast(listed) if self.small else listed.hint("shuffle_hash"), on)
