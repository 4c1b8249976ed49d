import random
from collections import defaultdict

import helpers as H
import numpy as np
import pyarrow as pa

from broadsheet.llm import near_dedup as N
from broadsheet.llm import shingles as S

COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def plain(docs):
    sets, seen, parent = [H.shingles(t) for _, t in docs], defaultdict(list), list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, own in enumerate(sets):
        shared = defaultdict(int)
        for gram in own:
            for j in seen[gram]:
                shared[j] += 1
            seen[gram].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(own) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None and sets[i]:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    out = []
    for i, (doc_id, _) in enumerate(docs):
        component = least.get(find(i)) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(out, key=H.key)


def family(seed, size, edits):
    pick = random.Random(seed)
    base = [f"{seed}w{i}" for i in range(60)]
    for _ in range(size):
        words = list(base)
        for _ in range(pick.randint(0, edits)):
            words[pick.randrange(60)] = f"z{pick.random()}"
        yield " ".join(words)


CASES = H.ODD + [(100 + i, t) for i, t in enumerate(family(1, 40, 2))] + [
    (200 + i, t) for i, t in enumerate(family(2, 30, 4))]


def test_small(spark):
    assert H.rows(N.near_duplicates(H.clashing(spark, CASES)), *COLUMNS) == plain(CASES)


def test_documents_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(N, "BROADCAST_ROWS", -1)
    docs = H.documents(spark)
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert H.rows(N.near_duplicates(docs), *COLUMNS) == want
    assert any(not r[3] for r in want)


def test_filter(spark):
    docs = H.clashing(spark, CASES)
    kept = N.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = {(r[0], r[1]) for r in plain(CASES) if r[3] and r[1]}
    bare = [r for r in plain(CASES) if not r[1]]
    got = [(r.doc_id, len(H.shingles(r.text))) for r in kept.collect()]
    assert sorted(got, key=H.key) == sorted([*want, *((r[0], 0) for r in bare)], key=H.key)
    assert N.drop_near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame(
        [(bytes([i]), bytes([i + 1])) for i in range(1, 30)] + [(b"\x50", b"\x51")],
        "a binary, b binary")
    got = {bytes(r["class"]): bytes(r.root) for r in N.components(edges).collect()}
    assert set(got.values()) == {b"\x01", b"\x50"} and len(got) == 30


def test_one_permutation_estimates_likeness():
    random_values = np.random.default_rng(1).integers(0, 1 << 63, 900).astype(np.uint64) * 2
    for size in (6, 40, 700):
        a, b = np.sort(random_values[:size]), np.sort(random_values[size // 4:size + size // 4])
        sig = S.one_permutation([a, b, a[:0]], 2048)
        want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sig[0] == sig[1]).mean() - want) < 0.08
        assert not sig[2].any()


def test_shingle_hashes_are_those_of_words():
    texts = ["A b  c\td e f", "a B c d e f", "a b c d", "A B C D", "", None, "a b c d e g"]
    sets = [s.tolist() for s in S.shingle_sets(pa.array(texts))]
    assert sets[0] == sets[1] and sets[2] == sets[3] and sets[4] == sets[5] == []
    assert len(set(sets[0]) & set(sets[6])) == 1 and len(sets[0]) == 2


def test_components_extended_are_those_of_all_links(spark):
    pick = random.Random(8)
    for many in (0, 5, 40):
        def some(count):
            return [(pick.randint(0, 30), pick.randint(0, 30)) for _ in range(count)]
        first, more = some(15), some(many)

        def frame(rows):
            return spark.createDataFrame(rows, "a long, b long").where("a <> b")
        want = N.components(frame(first + more))
        got = N.extended(N.components(frame(first)), frame(more))
        assert H.rows(got, "class", "root") == H.rows(want, "class", "root")


def test_rows_without_a_wanted_key_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(N, "BROADCAST_ROWS", -1)
    rows = spark.range(20_000).selectExpr("id AS bucket", "cast(id AS string) AS class")
    wanted = rows.where("bucket % 100 = 0").select("bucket")
    few = N._thinned(rows, "bucket", wanted, wanted.count())
    assert few.columns == rows.columns and 200 <= few.count() < 2_000
    assert H.rows(N._among(rows, "bucket", wanted), "bucket") == H.rows(wanted, "bucket")
    assert N._among(rows, "bucket", wanted.where("false")).count() == 0
    monkeypatch.setattr(N, "MOST_LONGS", 1)
    assert H.rows(N._among(rows, "bucket", wanted), "bucket") == H.rows(wanted, "bucket")


def test_only_sets_in_a_pair_are_shuffled_to_be_confirmed(spark, monkeypatch):
    seen = []
    among = N._among
    monkeypatch.setattr(N, "_among", lambda rows, key, wanted: seen.append(
        among(rows, key, wanted)) or seen[-1])
    names = [bytes([i]) * 16 for i in range(50)]
    one = np.arange(100, dtype=np.uint64).tobytes()
    sets = spark.createDataFrame([(bytearray(n), bytearray(one)) for n in names],
                                 "class binary, set binary")
    pairs = spark.createDataFrame([(bytearray(names[0]), bytearray(names[1]))],
                                  "a binary, b binary")
    assert N.confirm(pairs, sets).count() == 1
    assert sorted(bytes(r["class"]) for r in seen[0].collect()) == names[:2]


def shuffles(rows):
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_small_steps_shuffle_little(spark, monkeypatch):
    """Each shuffle is a round over all partitions, however few rows there are."""
    written = []

    def materialize(rows, name, codec="zstd", run=N.materialize):
        written.append((name, shuffles(rows)))
        return run(rows, name, codec)
    monkeypatch.setattr(N, "materialize", materialize)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        star = spark.createDataFrame([(0, i) for i in range(1, 30)] * 2, "a long, b long")
        assert sorted(N.components(star).collect()) == [(i, 0) for i in range(1, 30)]
        assert written == [("edges", 0), ("neighbours", 1)]
        names = [bytearray([i]) * 16 for i in range(50)]
        one = bytearray(np.arange(100, dtype=np.uint64).tobytes())
        sets = spark.createDataFrame([(n, one) for n in names], "class binary, set binary")
        pairs = spark.createDataFrame([(names[0], n) for n in names[1:]], "a binary, b binary")
        found = N.confirm(pairs, sets)
        assert found.count() == 49 and not shuffles(found) and len(written) == 2
        monkeypatch.setattr(N, "SENT_BYTES", 0)
        found = N.confirm(pairs, sets)
        assert found.count() == 49 and shuffles(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
