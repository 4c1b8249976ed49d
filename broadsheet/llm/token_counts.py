"""Token counts per section: whole documents encoded once, tokens given to sections.

The character span of each token is laid over the spans of the sections. A token that
crosses a border counts for the section that holds its first byte; so the counts of the
sections add up to the tokens of the document, which counting each section by itself
would not give.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from broadsheet.llm import byte_bpe

TEXTS = 256
BREAK = b"\n"
SCHEMA = ("doc_id long, section int, start_char long, end_char long, n_chars long, "
          "n_tokens long, n_crossing long, doc_tokens long")


def section_spans(data: bytes) -> np.ndarray:
    """Byte edges of sections: each ends with its line break; the last may have none.

    An empty text is one empty section.
    """
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == BREAK[0]) + 1
    return np.unique(np.r_[0, breaks, len(data)]) if data else np.array([0, 0])


def attribute(starts: np.ndarray, ends: np.ndarray, edges: np.ndarray):
    """Tokens of each section by first byte, and those that reach past its end."""
    section = np.searchsorted(edges, starts, "right") - 1
    many = len(edges) - 1
    return (np.bincount(section, minlength=many),
            np.bincount(section[ends > edges[section + 1]], minlength=many))


def _count(path: str):
    def run(batches):
        encoder = byte_bpe.encoder(path)
        widths = encoder.token_bytes()
        for batch in batches:
            for first in range(0, len(batch), TEXTS):
                part = batch.slice(first, TEXTS)
                texts = part.column("text").to_pylist()
                rows = []
                for nth, (text, raw) in enumerate(zip(texts, encoder.encode(texts))):
                    data = (text or "").encode()
                    ends = np.cumsum(widths[np.frombuffer(raw, encoder.dtype)])
                    starts = np.r_[0, ends[:-1]] if len(ends) else ends
                    edges = section_spans(data)
                    own, crossing = attribute(starts, ends, edges)
                    # Bytes that begin a character, for the spans in characters.
                    heads = np.r_[0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)]
                    chars = heads[edges]
                    many = len(edges) - 1
                    rows.append((np.full(many, nth), np.arange(many), chars[:-1], chars[1:],
                                 np.diff(chars), own, crossing, np.full(many, len(ends))))
                if rows:
                    nth, *figures = (np.concatenate(c) for c in zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(nth)),
                         pa.array(figures[0].astype(np.int32)),
                         *(pa.array(f.astype(np.int64)) for f in figures[1:])],
                        [c.split()[0] for c in SCHEMA.split(", ")])
    return run


def section_tokens(documents: DataFrame, path: str) -> DataFrame:
    """One row per document and section (line): its span, tokens, and border crossers.

    A map over rows, so no key can be hot. Null reads as empty: one empty section
    without tokens. Repeated rows give repeated rows; other columns are not read.
    """
    return documents.select("doc_id", "text").mapInArrow(_count(path), SCHEMA)
