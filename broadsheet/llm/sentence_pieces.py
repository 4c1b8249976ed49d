"""SentencePiece BPE encoding by a table of each prefix's last token, and decoding.

For byte-pair merges the encoding of every prefix of a text is unique, so a table can
hold, for each prefix, its last token: among the vocabulary pieces that end there (found
by an automaton) it is the one compatible with the last token of the prefix before it.
Two tokens are compatible if no merge ever crosses their border while both are built,
which is told by walking back the merges of both. The ids are read off backwards.

No piece holds the space mark after another character, so each space-led word is encoded
on its own, once per worker while it stays in a bounded cache.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from broadsheet.llm.storage import trimmed

SPACE = "▁"
CACHE_WORDS = 700_000
# Words kept while ids are made as lists: their workers run beside full executors.
PACKED_WORDS = 300_000
# Pairs of tokens whose fit is remembered, some 170 bytes each.
FITS = 400_000
LONGEST = 64
TEXTS = 256


class Pieces:
    """The model's pieces; ``path`` names a BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.names = [model.id_to_piece(i) for i in range(size)]
        self.bytes = {}
        self.rank: dict[str, int] = {}
        self.ids: dict[str, int] = {}
        scored = []
        self.end, self.unknown = model.eos_id(), model.unk_id()
        self.control = {i for i in range(size) if model.is_control(i)}
        for i, name in enumerate(self.names):
            if model.is_byte(i):
                self.bytes[int(name[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[name] = i
                scored.append((-model.get_score(i), i))
        self.byte_of = {i: b for b, i in self.bytes.items()}
        if any(SPACE in n.lstrip(SPACE) for n in self.ids):
            raise ValueError("a piece holds a space mark inside")
        for place, (_, i) in enumerate(sorted(scored)):
            if len(self.names[i]) > 1:
                self.rank[self.names[i]] = place
        self.chars = {n for n in self.ids if len(n) == 1}
        self.halves: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for name, i in self.ids.items():
            if len(name) == 1 or self._derive(name):
                self.automaton.add_word(name, name)
        self.automaton.make_automaton()
        # A break that no piece holds parts words too, which keeps them short.
        stop = "" if any("\n" in n for n in self.ids) else "\n"
        self.unit = re.compile(f"{SPACE}+[^{SPACE}{stop}]*|[^{SPACE}{stop}]+"
                               + (f"|{stop}" if stop else ""))
        self.fits: dict[tuple[str, str], bool] = {}
        self.packed: dict[str, bytes] = {}
        self.decimal: dict[str, bytes] = {}
        self.decoded: dict[str, str] = {}
        self.views = {
            id(self.packed): lambda ids: struct.pack(f"<{len(ids)}i", *ids),
            id(self.decimal): lambda ids: ("%d " * len(ids) % tuple(ids)).encode(),
            id(self.decoded): self.pieces_text,
        }

    def _derive(self, name: str) -> bool:
        """Notes the last merge that builds ``name``; false if merges don't build it."""
        parts = list(name)
        if not all(c in self.chars for c in parts):
            return False
        while len(parts) > 2:
            best = min(((self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:]))
                        if a + b in self.rank), default=None)
            if best is None:
                return False
            k = best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        if len(parts) == 2:
            self.halves[name] = (parts[0], parts[1])
        return len(parts) == 2

    def compatible(self, left: str, right: str) -> bool:
        """True if encoding ``left + right`` gives just these two tokens."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= FITS:
                self.fits.clear()
            known = self.fits[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: str, right: str) -> bool:
        rank, halves = self.rank, self.halves
        limit = len(self.names)
        while True:
            joined = rank.get(left + right)
            if joined is not None and joined < limit:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a > b:
                limit, left = a, halves[left][1]
            elif b >= 0:
                # A merge across the border comes first among equals: it is further left.
                limit, right = b + 1, halves[right][0]
            else:
                return True

    def _run(self, text: str) -> list[int]:
        """Ids of a run of characters that are all pieces."""
        last: list[str | None] = [None] * (len(text) + 1)
        fits, known = self.compatible, self.fits.get
        for end, name in self.automaton.iter(text):
            end += 1
            if last[end] is None:
                start = end - len(name)
                if not start:
                    last[end] = name
                elif (before := last[start]) is not None:
                    fit = known((before, name))
                    if fits(before, name) if fit is None else fit:
                        last[end] = name
        ids, at = [], len(text)
        while at:
            name = last[at]
            ids.append(self.ids[name])
            at -= len(name)
        return ids[::-1]

    def encode_unit(self, unit: str) -> list[int]:
        out, start = [], 0
        chars = self.chars
        for k, char in enumerate(unit):
            if char not in chars:
                if start < k:
                    out += self._run(unit[start:k])
                out += [self.bytes[b] for b in char.encode()]
                start = k + 1
        return out + self._run(unit[start:]) if start < len(unit) else out

    def units(self, text: str | None) -> list[str]:
        return self.unit.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str | None) -> list[int]:
        """Ids as the library gives them, with the end id."""
        return [i for u in self.units(text) for i in self.encode_unit(u)] + [self.end]

    def pieces_text(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.control:
                out.append(self.names[i].replace(SPACE, " "))
        out.append(raw.decode(errors="replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.pieces_text(ids)
        return text[1:] if text[:1] == " " else text

    def _joined(self, text: str | None, most: int, *caches: dict):
        """What the caches, of ``most`` words, hold for a text; new words are encoded first."""
        units = self.units(text)
        new = [u for u in set(units) if u not in caches[0]]
        if new:
            if len(caches[0]) + len(new) > most:
                for known in caches:
                    known.clear()
                new = set(units)
            for unit in new:
                ids = self.encode_unit(unit)
                for known in caches:
                    known[unit] = self.views[id(known)](ids)
        out = [b"".join(map(c.__getitem__, units)) if c is not self.decoded
               else "".join(map(c.__getitem__, units)) for c in caches]
        for unit in new:
            if len(unit) > LONGEST:     # rare and large: not worth keeping
                for known in caches:
                    del known[unit]
        return out

    def packed_ids(self, text: str | None) -> bytes:
        """Ids as 32-bit integers, with the end id."""
        return self._joined(text, PACKED_WORDS, self.packed)[0] + struct.pack("<i", self.end)

    def digest(self, text: str | None) -> tuple[bytes, str]:
        """Decimal ids joined by spaces, with the end id, and the decoded text.

        Words have whole characters, so the text of each is decoded by itself.
        """
        ids, back = self._joined(text, CACHE_WORDS, self.decimal, self.decoded)
        return ids + str(self.end).encode(), back[1:] if back[:1] == " " else back


@cache
def pieces(path: str) -> Pieces:
    """One table per worker process and model."""
    return Pieces(path)


def _rows(path: str, make, columns: list[tuple[str, pa.DataType]]):
    def run(batches):
        table = pieces(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows = [make(table, t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([r[i] for r in rows], kind)
                                           for i, (_, kind) in enumerate(columns))],
                ["doc_id", *(n for n, _ in columns)])
    return run


def _encode(path: str):
    @trimmed
    def run(batches):
        table = pieces(path)
        for batch in batches:
            for first in range(0, len(batch), TEXTS):
                part = batch.slice(first, TEXTS)
                raw = [table.packed_ids(t) for t in part.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, raw)]) // 4
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()),
                    pa.array(np.frombuffer(b"".join(raw), "<i4"), pa.int32()))],
                    ["doc_id", "ids"])
    return run


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the token ids of each whole text, null as empty, one row per row."""
    return documents.select("doc_id", "text").mapInArrow(
        _encode(path), "doc_id long, ids array<int>")


def _decode(path: str):
    def run(batches):
        table = pieces(path)
        for batch in batches:
            texts = [table.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])
    return run


def decode_documents(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text): the text of each list of ids; null reads as an empty list."""
    return tokens.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, text string")


def _decoded(path: str):
    @trimmed
    def run(batches):
        table = pieces(path)
        count = range(len(table.names))
        decimal = [str(i) for i in count]
        alone = [table.pieces_text([i]) for i in count]
        # Bytes make characters together, so ids with any are decoded as a whole.
        is_byte = np.zeros(len(count), bool)
        is_byte[list(table.byte_of)] = True

        def digests(ids):
            back = (table.decode(ids) if is_byte[ids].any()
                    else "".join(map(alone.__getitem__, ids)).removeprefix(" ")) if ids else ""
            return [hashlib.sha256(s.encode()).hexdigest() for s in (
                " ".join(map(decimal.__getitem__, ids)), back)]

        for batch in batches:
            for first in range(0, len(batch), TEXTS):
                part = batch.slice(first, TEXTS)
                rows = [digests(ids or []) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("ids"),
                     *(pa.array([r[i] for r in rows], pa.string()) for i in (0, 1))],
                    ["doc_id", "ids", "ids_sha256", "decoded_sha256"])
    return run


def decoded_digests(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, ids_sha256, decoded_sha256): digests as those of ``token_digest``.

    The text is decoded from the ids given; null reads as an empty list.
    """
    return tokens.select("doc_id", "ids").mapInArrow(
        _decoded(path),
        "doc_id long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def _digest(table: Pieces, text: str | None):
    ids, back = table.digest(text)
    return (ids.count(b" ") + 1, hashlib.sha256(ids).hexdigest(),
            hashlib.sha256(back.encode()).hexdigest())


def token_digest(documents: DataFrame, path: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the decoded text.

    A map over rows: nothing is shuffled. Null and empty texts have the end id only;
    repeated rows give repeated rows; other columns are not read.
    """
    return documents.select("doc_id", "text").mapInArrow(_rows(path, _digest, [
        ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
