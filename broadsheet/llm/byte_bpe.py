"""Token ids of whole texts with the tokenizers library, word by word.

Byte-level BPE never merges across the words of its pre-tokenizer, so each word is
encoded once per worker, by the library, and texts are joined from the ids of their
words. Texts with characters that the two pattern engines might class differently, or
with a special token's name, go to the library as a whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LAST = 0x24F        # of the characters whose classes all engines agree on


def _class(major: str) -> str:
    """The characters up to ``LAST`` of one major Unicode category, as class ranges."""
    return "".join(re.escape(chr(c)) for c in range(0x21, LAST + 1)
                   if unicodedata.category(chr(c))[0] == major)


# Fixed value: the pre-tokenizer's pattern, with its classes written out for the
# characters that ``UNSURE`` lets through.
LETTER, NUMBER, SPACE = _class("L"), _class("N"), " \t\n\r"
WORD = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+"
    f"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
UNSURE = re.compile(f"[^\t\n\r\x20-\x7e\xa1-{chr(LAST)}]|<\\|endoftext\\|>")
CACHE_WORDS = 1_200_000
LONGEST = 64
SLICE_BYTES = 1 << 22
SPECIAL = "<|endoftext|>"

# Classes of the characters up to ``LAST``; 4 marks those that ``UNSURE`` names.
_SPACE, _LETTER, _NUMBER, _OTHER, _BAD = range(5)


def _class_table() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], _OTHER)
                      for c in range(LAST + 1)], np.uint8)
    table[[*range(0x20), *range(0x7F, 0xA1)]] = _BAD
    table[[ord(c) for c in SPACE]] = _SPACE
    return table


_CLASSES = _class_table()
_BYTE_CLASSES = np.concatenate([_CLASSES[:0x80], np.full(0x80, _BAD, np.uint8)])


def word_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``WORD`` start in UTF-8 rows, and which rows are unsure.

    Words cover a row without gaps. Starts of unsure rows mean nothing.
    """
    kind = _BYTE_CLASSES[data]
    lead = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
    if len(lead):
        code = ((data[lead].astype(np.int64) & 31) << 6) | (data[lead + 1] & 63)
        kind[lead] = kind[lead + 1] = np.where(
            code <= LAST, _CLASSES[np.minimum(code, LAST)], _BAD)
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    first, last = fresh[:-1], fresh[1:]
    blank, space = kind == _SPACE, data == 0x20
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= first
    after_space = np.zeros(len(data), bool)
    after_space[1:] = space[:-1]
    after_space &= ~first
    ends = np.zeros(len(data), bool)        # blanks with something else behind them
    ends[:-1] = ~blank[1:]
    ends &= ~last
    start = np.where(blank, change | ends, change & ~after_space)
    _contractions(data, kind, first, start)
    bad = np.concatenate([[0], np.cumsum(kind == _BAD)])
    return np.flatnonzero(start), np.diff(bad[offsets]) > 0


def _contractions(data, kind, first, start) -> None:
    """'s 't 're 've 'm 'll 'd where a word starts: words of their own."""
    n = len(data)

    def byte(at):
        return np.where(at < n, data[np.minimum(at, n - 1)], 0)
    at = np.flatnonzero((data == 0x27) & start)
    at = at[at + 1 < n]
    at = at[(kind[at + 1] == _LETTER) & ~first[at + 1]]
    one, two = byte(at + 1), byte(at + 2)
    two = np.where((at + 2 < n) & ~first[np.minimum(at + 2, n - 1)], two, 0)
    size = np.where(np.isin(one, list(b"stmd")), 2, 0)
    for a, b in (b"re", b"ve", b"ll"):
        size[(one == a) & (two == b)] = 3
    at, size = at[size > 0], size[size > 0]
    start[at + 1] = False
    end = at + size
    end = end[end < n]
    start[end[(kind[end] == _LETTER) & ~first[end]]] = True


class Encoder:
    """Encodes texts to little-endian 16- or 32-bit ids."""

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bits = max(1, (self.size - 1).bit_length())
        self.dtype = np.dtype("<u2" if self.bits <= 16 else "<u4")
        self.words: dict[str, bytes] = {}
        self._forget()

    def token_bytes(self) -> np.ndarray:
        """Length in bytes of the text of each id."""
        lengths = np.zeros(self.size, np.int64)
        added = self.tokenizer.get_added_tokens_decoder()
        for token, at in self.tokenizer.get_vocab(with_added_tokens=True).items():
            # Each character of a byte-level token stands for one byte.
            lengths[at] = len(token.encode()) if at in added else len(token)
        return lengths

    def _learn(self, missing: list[str]) -> None:
        if len(self.words) + len(missing) > CACHE_WORDS:
            self.words.clear()
        done = self.tokenizer.encode(missing, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(done.ids, self.dtype)
        counts = np.bincount(np.array(done.word_ids, np.int64), minlength=len(missing))
        raw, width, at = ids.tobytes(), self.dtype.itemsize, 0
        for word, n in zip(missing, counts.tolist()):
            self.words[word] = raw[at:at + n * width]
            at += n * width

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids,
                        self.dtype).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null reads as empty."""
        cut = [None if not t or UNSURE.search(t) else WORD.findall(t) for t in texts]
        wanted = set().union(*(c for c in cut if c))
        if len(self.words) + len(wanted) > CACHE_WORDS:
            self.words.clear()
        missing = [w for w in wanted if w not in self.words]
        long = [w for w in missing if len(w) > LONGEST]
        short = [w for w in missing if len(w) <= LONGEST]
        if short:
            self._learn(short)
        for word in long:
            self.words[word] = self.whole(word)
        get = self.words.__getitem__
        out = [b"".join(map(get, c)) if c else self.whole(t) if t else b""
               for t, c in zip(texts, cut)]
        for word in long:
            del self.words[word]
        return out

    def _entries(self, words: list[bytes]) -> np.ndarray:
        """The entry of each word in the flat store of ids, new ones encoded."""
        if len(self.entry) + len(words) > CACHE_WORDS:
            self._forget()
        get = self.entry.get
        found = np.array([get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            missing = [words[i] for i in new.tolist()]
            done = self.tokenizer.encode([w.decode() for w in missing], is_pretokenized=True,
                                         add_special_tokens=False)
            ids = np.array(done.ids, self.dtype)
            counts = np.bincount(np.array(done.word_ids, np.int64), minlength=len(missing))
            found[new] = len(self.entry) + np.arange(len(new))
            self.entry.update(zip(missing, found[new].tolist()))
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
            self.flat = np.concatenate([self.flat, ids])
        return found

    def _forget(self) -> None:
        self.entry: dict[bytes, int] = {}
        self.ends, self.flat = np.zeros(1, np.int64), np.zeros(0, self.dtype)

    def encode_rows(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each row of a text column in order; null reads as empty.

        Words are cut with numpy and made distinct by Arrow, so each slice asks the
        library for its new words alone and joins the ids of the others by offsets.
        """
        texts = texts.fill_null("").cast(pa.large_string())
        special = pc.match_substring(texts, SPECIAL).to_numpy(zero_copy_only=False)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[
            texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        row = 0
        while row < len(texts):
            end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
            end = min(max(end, row + 1), len(texts))
            ids, ends, whole = self._slice(data[offsets[row]:offsets[end]],
                                           offsets[row:end + 1] - offsets[row])
            for i in range(end - row):
                if whole[i] or special[row + i]:
                    yield np.frombuffer(self.whole(texts[row + i].as_py()), self.dtype)
                else:
                    yield ids[ends[i]:ends[i + 1]]
            row = end

    def _slice(self, data: np.ndarray, offsets: np.ndarray):
        """Ids, their row borders, and the rows that have to be encoded whole."""
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(rows + 1, np.int64), np.zeros(rows, bool)
        starts, whole = word_starts(data, offsets)
        row_of = np.searchsorted(offsets, starts, "right") - 1
        bounds = np.concatenate([starts, [len(data)]])
        sizes = np.diff(bounds)
        # A row with a very long word goes to the library whole, so no such word is kept.
        whole[row_of[sizes > LONGEST]] = True
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts),
            [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
        words = (words.filter(pa.array(~whole[row_of])) if whole.any() else words
                 ).dictionary_encode()
        entry = self._entries(words.dictionary.to_pylist())
        entry = entry[words.indices.to_numpy(zero_copy_only=False)]
        counts = self.ends[entry + 1] - self.ends[entry]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = self.flat[np.repeat(self.ends[entry] - upto[:-1], counts) + np.arange(upto[-1])]
        kept = np.bincount(row_of[~whole[row_of]], minlength=rows)
        return ids, upto[np.concatenate([[0], np.cumsum(kept)])], whole


@cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)
