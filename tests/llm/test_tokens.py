import hashlib
import random
import re
import zlib

import helpers as H
import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from broadsheet.llm import sentence_pieces, token_counts, token_files

BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")


def byte_ids(text):
    return Tokenizer.from_file(BYTE).encode(text or "", add_special_tokens=False).ids


def test_bit_packing():
    for bits in (1, 7, 13, 16, 17, 20):
        ids = np.random.default_rng(1).integers(0, 1 << bits, 9001).astype(np.uint32)
        file = token_files.TokenFile(
            token_files.write_file(ids, np.array([1, 0, 9000]), bits, 512))
        assert (file.ids(0, 9001) == ids).all() and (file.ids(700, 5200) == ids[700:5200]).all()
        assert (file.document(2) == ids[1:]).all() and not len(file.document(1))


def check_files(data, frame):
    tokenizer = Tokenizer.from_file(BYTE)
    coded = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in data]
    coded.sort(key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes()))
    want, start = [], 0
    for doc_id, ids in coded:
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in frame.collect()), key=lambda r: r[1]) == want


def test_token_files(spark, monkeypatch):
    check_files(H.ODD, token_files.token_report(H.clashing(spark), BYTE))
    monkeypatch.setattr(token_files, "ROWS_PER_FILE", 7)
    docs = H.documents(spark)
    check_files([(r.doc_id, r.text) for r in docs.collect()], token_files.token_report(docs, BYTE))
    assert token_files.token_report(spark.createDataFrame([], H.DOCS), BYTE).count() == 0


def check_counts(data, frame):
    tokenizer, want = Tokenizer.from_file(BYTE), []
    for doc_id, text in data:
        text = text or ""
        spans = tokenizer.encode(text, add_special_tokens=False).offsets
        at = 0
        for k, part in enumerate(re.findall(r"[^\n]*\n|[^\n]+", text) or [""]):
            end = at + len(part)
            own = [s for s in spans if at <= s[0] < end]
            want.append((doc_id, k, at, end, len(part), len(own), sum(s[1] > end for s in own),
                         len(spans)))
            at = end
    assert sorted((tuple(r) for r in frame.collect()), key=H.key) == sorted(want, key=H.key)


def test_token_counts(spark):
    check_counts(H.ODD, token_counts.section_tokens(H.clashing(spark), BYTE))
    docs = H.documents(spark)
    check_counts([(r.doc_id, r.text) for r in docs.collect()],
                 token_counts.section_tokens(docs, BYTE))


def test_border_rule():
    own, crossing = token_counts.attribute(
        np.array([0, 2, 5]), np.array([2, 5, 7]), np.array([0, 4, 7]))
    assert own.tolist() == [2, 1] and crossing.tolist() == [1, 0]


def test_pieces_are_those_of_the_library():
    table, library = sentence_pieces.pieces(PIECE), sentencepiece.SentencePieceProcessor(
        model_file=PIECE)
    pick = random.Random(1)
    letters = "abcdehinorst ,.'-▁\n\t0129éüñ中文字😀ͅ\x00​AÉ"
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(pick.choice("ab ") for _ in range(200)) for _ in range(100)]
    texts += ["".join(pick.choice(table.names[259:]) for _ in range(8)) for _ in range(2000)]
    texts += ["a" * 500, "▁" * 50 + "a", " " * 70, "=-" * 100, "<s></s><unk><0x0A>", ""]
    for text in texts:
        ids = table.encode(text)
        assert ids == library.encode(text) + [2], text
        assert table.decode(ids) == library.decode(ids), text


def check_pieces(data, frame):
    library, want = sentencepiece.SentencePieceProcessor(model_file=PIECE), []
    for doc_id, text in data:
        ids = library.encode(text or "") + [2]
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted((tuple(r) for r in frame.collect()), key=H.key) == sorted(want, key=H.key)


def test_piece_digests(spark):
    check_pieces(H.ODD, sentence_pieces.token_digest(H.clashing(spark), PIECE))
    docs = H.documents(spark)
    check_pieces([(r.doc_id, r.text) for r in docs.collect()],
                 sentence_pieces.token_digest(docs, PIECE))


def test_piece_round_trip(spark):
    docs = spark.createDataFrame([r for r in H.ODD if r[0] and "▁" not in r[1]], H.DOCS)
    back = sentence_pieces.decode_documents(sentence_pieces.encode_documents(docs, PIECE), PIECE)
    assert H.rows(back, "doc_id", "text") == H.rows(docs, "doc_id", "text")


def test_small_word_caches_give_the_same_ids(monkeypatch):
    texts = [f"w{i} x{i * 7} " * 3 + f"y{i}z" for i in range(300)] + [None, "", "a " * 500]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    table = sentence_pieces.Pieces(PIECE)
    monkeypatch.setattr(sentence_pieces, "PACKED_WORDS", 40)
    monkeypatch.setattr(sentence_pieces, "FITS", 30)
    for text in texts:
        assert np.frombuffer(table.packed_ids(text), "<i4").tolist() == library.encode(text or "") + [2]
        assert len(table.packed) <= 40 and len(table.fits) <= 30
