"""Arrow text columns as flat byte arrays, and hashes of byte ranges; helpers used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task works on at once; a single longer text is taken alone.
CHUNK_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one ``uint8`` array and the ``n + 1`` offsets into it; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[at[0]:at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class RangeHash:
    """64-bit hashes of byte ranges (or of ranges of other integers), equal for equal content.

    A polynomial with a random odd base over scrambled symbols, from prefix sums modulo 2**64.
    """

    def __init__(self, symbols: np.ndarray, seed: int = 1):
        n = len(symbols)
        if symbols.dtype == np.uint8:
            values = mixed(np.arange(256, dtype=np.uint64) + np.uint64(seed * 1000003))[symbols]
        else:
            values = mixed(symbols.astype(np.uint64) + np.uint64(seed * 1000003))
        power = np.full(n, _BASE, np.uint64)
        if n:
            power[0] = 1
            np.multiply.accumulate(power, out=power)
            values *= power
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(values, out=self.prefix[1:])
        self.back = np.full(n + 1, _INVERSE, np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = (ends - starts).astype(np.uint64)
        return mixed((self.prefix[ends] - self.prefix[starts]) * self.back[starts] + length)

    def rolling(self, width: int) -> np.ndarray:
        """Hash of every range of ``width`` symbols, by start."""
        n = len(self.prefix) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.prefix[width:] - self.prefix[:n]) * self.back[:n] + np.uint64(width))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as ``int64``, the type Spark has."""
    return x.view(np.int64)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the number of the first word of each text (``n + 1`` values).

    ``inside`` says for each of the 256 bytes whether it is part of a word; a word never crosses texts.
    """
    flags = inside[data]
    opens = flags.copy()
    opens[1:] &= ~flags[:-1]
    closes = flags.copy()
    closes[:-1] &= ~flags[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    if len(cuts):
        opens[cuts] = flags[cuts]
        closes[cuts - 1] = flags[cuts - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)
