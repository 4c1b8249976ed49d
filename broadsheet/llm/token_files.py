"""Token ids in files: fixed-width bit packing with block offsets.

A file holds consecutive documents. Each id takes the least number of bits that holds the
vocabulary; ids are cut into blocks of ``BLOCK`` ids, each starting on a byte whose offset
the file lists, so any id range is read by unpacking its blocks alone with numpy. Files
are binary values of a Parquet table with one row per file, in ascending id order, which
any store that Spark writes to can hold; a second small table has the number of ids
before each file.
"""

from __future__ import annotations

import struct
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from broadsheet.llm import byte_bpe
from broadsheet.llm.ordering import id_buckets
from broadsheet.llm.storage import materialize

MAGIC = b"TOKBITS1"
HEAD = struct.Struct("<8sIIQQ")     # magic, bits, ids in a block, documents, ids
BLOCK = 4096
END_ID = 2
ROWS_PER_FILE = 512
TEXTS = 256


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, low bits first, filled up to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(wide.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(raw, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), count=count * bits, bitorder="little")
    return (flat.reshape(count, bits) << np.arange(bits, dtype=np.uint32)).sum(
        axis=1, dtype=np.uint32)


def write_file(ids: np.ndarray, lengths: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """One file: header, end of each document in ids, byte offset of each block, blocks."""
    blocks = [pack_bits(ids[i:i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    return b"".join([HEAD.pack(MAGIC, bits, block, len(lengths), len(ids)),
                     np.cumsum(lengths).astype("<u8").tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """Reads a file of ``write_file``; only the blocks asked for are unpacked."""

    def __init__(self, raw):
        self.raw = memoryview(raw)
        magic, self.bits, self.block, documents, self.size = HEAD.unpack_from(self.raw)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size
        self.ends = np.frombuffer(self.raw, "<u8", documents, at).astype(np.int64)
        at += 8 * documents
        count = -(-self.size // self.block)
        self.offsets = np.frombuffer(self.raw, "<u8", count + 1, at).astype(np.int64)
        self.data = at + 8 * (count + 1)

    def ids(self, start: int, end: int) -> np.ndarray:
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        parts = [unpack_bits(self.raw[self.data + self.offsets[b]:self.data + self.offsets[b + 1]],
                             self.bits, min(self.block, self.size - b * self.block))
                 for b in range(first, last + 1)]
        skip = first * self.block
        return np.concatenate(parts)[start - skip:end - skip]

    def document(self, nth: int) -> np.ndarray:
        return self.ids(int(self.ends[nth - 1]) if nth else 0, int(self.ends[nth]))


def _encode(path: str):
    def run(batches):
        encoder = byte_bpe.encoder(path)
        end = np.array([END_ID], encoder.dtype).tobytes()
        for batch in batches:
            coded = encoder.encode_rows(batch.column("text"))
            for first in range(0, len(batch), TEXTS):
                part = batch.slice(first, TEXTS)
                raw = [ids.tobytes() + end for ids in islice(coded, len(part))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("bucket"), pa.array(raw, pa.binary())],
                    ["doc_id", "bucket", "ids"])
    return run


def _files(dtype: np.dtype, bits: int):
    def run(table: pa.Table) -> pa.Table:
        # Ascending ids, null first; rows of equal id by their token ids.
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("ids").to_pylist()),
                      key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        ids = np.frombuffer(b"".join(r[1] for r in rows), dtype)
        lengths = np.array([len(r[1]) // dtype.itemsize for r in rows], np.int64)
        return pa.table({
            "bucket": table.column("bucket").slice(0, 1),
            "doc_ids": pa.array([[r[0] for r in rows]], pa.list_(pa.int64())),
            "n_ids": pa.array([len(ids)], pa.int64()),
            "file": pa.array([write_file(ids, lengths, bits)], pa.binary())})
    return run


def write_tokens(documents: DataFrame, path: str) -> DataFrame:
    """The written files: bucket, doc_ids, n_ids, file; buckets ascend with the ids.

    Every whole text is encoded, null as empty, and gets the end id.
    """
    info = byte_bpe.Encoder(path)
    rows = documents.select("doc_id", "text")
    rows = rows.withColumn("bucket", id_buckets(rows, "doc_id", ROWS_PER_FILE))
    ids = rows.mapInArrow(_encode(path), "doc_id long, bucket long, ids binary")
    files = ids.groupBy("bucket").applyInArrow(
        _files(info.dtype, info.bits),
        "bucket long, doc_ids array<long>, n_ids long, file binary")
    return materialize(files, "token-files")


def _read(batches):
    for batch in batches:
        rows = []
        for doc_ids, base, raw in zip(*(batch.column(c) for c in ("doc_ids", "base", "file"))):
            file, start = TokenFile(raw.as_buffer()), base.as_py()
            for nth, doc_id in enumerate(doc_ids.as_py()):
                ids = file.document(nth)
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)],
            ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digest(files: DataFrame) -> DataFrame:
    """Per document, from the files: ids before it, its ids with the end id, their CRC-32.

    One row per row written; an empty or null text has the end id alone.
    """
    # One row per file, of which there is a bounded number: see ``ordering``.
    base = files.select("bucket", F.coalesce(F.sum("n_ids").over(Window.orderBy(
        "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return files.join(F.broadcast(base), "bucket").select("doc_ids", "base", "file").mapInArrow(
        _read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_report(documents: DataFrame, path: str) -> DataFrame:
    return read_digest(write_tokens(documents, path))
