import hashlib

import helpers as H
import public_tokenizers
import sentencepiece
import test_decontaminate
import test_near_dedup

import corpus_pipeline as P
from broadsheet.llm import quality
from broadsheet.llm.storage import materialize


def test_stages_against_plain_versions(spark):
    docs = H.documents(spark)
    stages = dict(P.STAGES)
    assert [n.split()[0] for n, _ in P.STAGES] == [
        "quality", "MinHash", "benchmark", "PII", "SentencePiece"]
    labels = spark.read.parquet(f"{H.SF}/labels.parquet")

    good = materialize(stages["quality classifier"](spark, docs, H.SF), "test")
    score = {r.doc_id: r.score for r in quality.quality_report(docs, labels).collect()}
    assert good.columns == docs.columns
    assert {r.doc_id for r in good.collect()} == {d for d, s in score.items() if s >= 0.7}

    once = materialize(stages["MinHash near-dedup"](spark, good, H.SF), "test")
    want = {r[0] for r in test_near_dedup.plain([(r.doc_id, r.text) for r in good.collect()])
            if r[3]}
    assert once.columns == docs.columns and {r.doc_id for r in once.collect()} == want

    clean = materialize(stages["benchmark decontamination"](spark, once, H.SF), "test")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{H.SF}/benchmark.parquet").collect()]
    want = {r[0] for r in test_decontaminate.plain(
        [(r.doc_id, r.text) for r in once.collect()], bench) if not r[5]}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == want

    masked = materialize(stages["PII"](spark, clean, H.SF), "test")
    assert masked.columns == docs.columns and masked.count() == clean.count()
    assert not masked.where("text rlike '[a-z]@[a-z]+[.][a-z]'").count()

    last = {r.doc_id: r.ids for r in P.run(spark, H.SF).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(P.TOKENIZER))
    assert last == {r.doc_id: library.encode(r.text) + [2] for r in masked.collect()}


def test_last_stage_decodes_its_ids(spark):
    docs = H.clashing(spark, [*H.ODD, *map(tuple, H.documents(spark).select("doc_id", "text").collect())])
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(P.TOKENIZER))
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "") + [2]
        want.append((r.doc_id, ids, *(hashlib.sha256(s.encode()).hexdigest() for s in (
            " ".join(map(str, ids)), library.decode(ids)))))
    last = dict(P.STAGES)["SentencePiece encoding and decoding"](spark, docs, H.SF)
    assert H.rows(last, "doc_id", "ids", "ids_sha256", "decoded_sha256") == sorted(want, key=H.key)


def test_last_stage_runs_one_worker_a_task(spark, capsys):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], H.DOCS)
    last = dict(P.STAGES)["SentencePiece encoding and decoding"](spark, docs, H.SF)
    last.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    assert last.count() == 2
