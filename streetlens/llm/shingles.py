"""Sets of word shingles as sorted 64-bit hashes; helper used inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from streetlens.llm.arrays import RangeHash, lower_ascii, text_bytes, word_spans


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``width`` words of each text, sorted, and where each text's begin (``n + 1`` values).

    Words are runs of bytes other than space and the bytes 9 to 13; A-Z is lower-cased. A text of fewer
    words is one shingle; one without words has none.
    """
    data, offsets = text_bytes(column)
    data = lower_ascii(data)
    inside = np.ones(256, bool)
    inside[[9, 10, 11, 12, 13, 32]] = False
    starts, ends, first = word_spans(data, offsets, inside)
    words = RangeHash(data).of(starts, ends)
    count = np.diff(first)
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(n)), n)
    begin = first[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    values = RangeHash(words, seed=2).of(begin, begin + np.minimum(count, width)[text])
    order = np.argsort(values)
    kind = np.uint16 if len(n) < 1 << 16 else np.int64
    order = order[np.argsort(text[order].astype(kind), kind="stable")]
    values, text = values[order], text[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[keep], np.searchsorted(text[keep], np.arange(len(n) + 1))
