"""Suffix-array dedup: remove every byte covered by a ``length``-byte string that starts more than once.

The method named for this, prefix doubling (pairs of ranks of every position, sorted at offsets that double), was
exchanged: nothing here is ranked, sorted as pairs or doubled.  Doubling needs a (rank, next rank, position) row per byte
and round; the README has the estimate, and no run of it was measured.  Instead, strings are compared by equal hashes at the
synchronised positions of ``repeats``, about 1.4 in 100: of a gram, then of the whole stretch, of blocks and of windows.

Defined cases: a null or empty text has no strings and stays empty; repeated rows are copies, so a row of at least
``length`` bytes that occurs twice goes whole; matches never cross rows; an empty table gives an empty result; extra
columns are carried or ignored and may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from urlsieve.llm.repeats import ByteUnits, equal_windows, remove_repeats

LENGTH = 200

_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _text(unit, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
    spans = [{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    kept = unit.without(data, starts, ends).decode("utf-8", "ignore") if spans else data.decode("utf-8", "ignore")
    return kept, spans


def _digest(unit, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
    return len(data), int((ends - starts).sum()), len(starts), hashlib.sha256(unit.without(data, starts, ends)).hexdigest()


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                          kept_col: str = "kept_text", spans_col: str = "removed_spans") -> DataFrame:
    """All columns but the text, with the kept text (a character that lost some of its bytes goes whole) and the
    removed byte runs."""
    carry = [c for c in docs.columns if c != text_col]
    return remove_repeats(docs, id_col, text_col, carry, ByteUnits, length, _text,
                          [(kept_col, pa.string()), (spans_col, _SPANS)], equal_windows)


def repeated_byte_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) per row."""
    return remove_repeats(docs, id_col, text_col, [id_col], ByteUnits, length, _digest,
                          [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())],
                          equal_windows)
