import zlib

import helpers as H
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from broadsheet.llm import packing

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def unroll(counts):
    """Every piece of a plan as (length, rank, sequence, offset); checks the packing."""
    runs, sequences = packing.plan_runs(counts)
    seen, held = np.zeros(len(counts), int), {}
    for length, rank, count, sequence, per, offset in runs.tolist():
        assert seen[length] == rank
        seen[length] += count
        for k in range(count):
            held.setdefault(sequence + k // per, []).append((offset + k % per * length, length))
    assert seen.tolist() == list(counts) and len(held) == sequences
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at < len(counts)
    return sequences


def test_plans_are_whole_and_close_to_the_bound():
    random = np.random.default_rng(4)
    for _ in range(40):
        counts = np.zeros(int(random.integers(2, 70)), int)
        counts[1:] = random.integers(0, 7, len(counts) - 1) * random.integers(0, 2, len(counts) - 1)
        unroll(counts)
    counts = np.zeros(1025, int)
    counts[1:] = random.poisson(3, 1024)
    tokens = int((counts * np.arange(1025)).sum())
    assert unroll(counts) <= 1.01 * -(-tokens // 1024)
    # One length with a third of all pieces, and pieces that fill a sequence in pairs only.
    counts[512] = 4000
    counts[1024] = 50
    unroll(counts)
    assert unroll(np.bincount([700] * 10 + [324] * 10, minlength=1025)) == 10
    assert unroll(np.zeros(1025, int)) == 0


def test_groups_have_equal_cardinality():
    counts = np.zeros(101, int)
    counts[40:100] = 10
    groups = packing.linear_groups(counts, 6)
    assert [(a, b) for _, a, b in groups] == [(i * 100, i * 100 + 100) for i in range(6)]
    assert [g[0] for g in groups] == [99, 89, 79, 69, 59, 49]


def check(data, rows):
    tokenizer, want = Tokenizer.from_file(BYTE), []
    for doc_id, text in data:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024
        edges = ([0] if first else []) + list(range(first, len(ids) + 1, 1024))
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            raw = np.array(ids[a:b], "<u4").tobytes()
            want.append((doc_id, k, a, b - a, zlib.crc32(raw)))
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted((tuple(r[n] for n in names) for r in rows), key=H.key) == sorted(want, key=H.key)
    held = {}
    for row in rows:
        held.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    return len(held), sum(r[3] for r in want)


def test_pack_documents(spark):
    check(H.ODD, packing.pack_documents(H.clashing(spark), BYTE).collect())
    docs = H.documents(spark)
    used, tokens = check([(r.doc_id, r.text) for r in docs.collect()],
                         packing.pack_documents(docs.repartition(7), BYTE).collect())
    assert used <= 1.02 * tokens / 1024 + 1
    assert packing.pack_documents(spark.createDataFrame([], H.DOCS), BYTE).count() == 0


@pytest.mark.parametrize("rows", [packing.BROADCAST_ROWS, 0])
def test_sequences_hold_the_ids(spark, monkeypatch, rows):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", rows)
    data = [(i, "some words " * (i % 50)) for i in range(300)] + [(7, "some words " * 7)] * 30
    packed = packing.pack_documents(
        spark.createDataFrame(data, H.DOCS).repartition(5), BYTE, 64, keep_ids=True)
    tokenizer = Tokenizer.from_file(BYTE)
    want = sorted(i for _, t in data
                  for i in tokenizer.encode(t, add_special_tokens=False).ids + [2])
    made = packing.sequences(packed).collect()
    assert all(r.n_tokens <= 64 and len(r.ids) == 4 * r.n_tokens for r in made)
    got = np.frombuffer(b"".join(bytes(r.ids) for r in made), "<u4")
    assert sorted(got.tolist()) == want
    assert sum(len(r.doc_ids) for r in made) == packed.count()
