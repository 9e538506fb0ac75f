"""Which keywords stand anywhere in a text: hashes of all its pieces as long as a keyword, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from operator import contains

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from streetlens.tasks.terms import chunks, in_bits, mixed, slices

#: Different hashes a task holds before it gives them out.
HELD_HASHES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SYMBOLS = mixed(np.arange(1, 257, dtype=np.uint64))


class Pieces:
    """Bytes of some texts, and 64-bit hashes of their pieces: a polynomial from prefix sums modulo 2**64."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        self.offsets = at - at[0]
        power = np.full(len(raw) + 1, _BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_SYMBOLS[raw] * power[:-1], dtype=np.uint64)))
        self.back = np.full(len(raw) + 1, _INVERSE, np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)

    def hashes(self, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        h = (self.prefix[starts + size] - self.prefix[starts]) * self.back[starts]
        return mixed(h + np.asarray(size, np.uint64)).view(np.int64)


def listed_counter(keywords: list[bytes]):
    """Task: texts to (text, n): in how many of its texts each keyword stands anywhere."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [0] * len(keywords)
        for chunk in chunks(batches, "body"):
            texts = chunk.column("body").cast(pa.large_binary()).drop_null().to_pylist()
            for i, keyword in enumerate(keywords):
                n[i] += sum(map(contains, texts, repeat(keyword)))
        yield pa.RecordBatch.from_arrays([pa.array(keywords, pa.binary()), pa.array(n, pa.int64())], ["text", "n"])

    return run


def ladder(sizes: list[int]) -> list[tuple[int, list[int]]]:
    """Lengths by the greatest power of two in them: a piece of that length starts every longer one."""
    steps: dict[int, list[int]] = {}
    for size in sorted(sizes):
        steps.setdefault(1 << size.bit_length() - 1, []).append(size)
    return sorted(steps.items())


def keyword_hasher(steps: list[int]):
    """Task: keywords to (text, h), and the hashes of their beginnings as long as a step to (null, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("text").cast(pa.string())
            pieces = Pieces(words)
            size, starts = np.diff(pieces.offsets), pieces.offsets[:-1]
            yield pa.RecordBatch.from_arrays([words, pa.array(pieces.hashes(starts, size))], ["text", "h"])
            for step in steps:
                h = np.unique(pieces.hashes(starts[size >= step], step))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.string()), pa.array(h)], ["text", "h"])

    return run


def piece_counter(sizes: list[int], light_bits, light_beginnings):
    """Task: texts to (h, n): in how many of its texts each piece stands whose hash may be that of a keyword.

    Longer lengths are looked for only where a keyword may begin, so the work grows with the steps of the ladder.
    """

    def found(batch: pa.RecordBatch) -> list[np.ndarray]:
        pieces = Pieces(batch.column("body"))
        bits, beginnings = light_bits.value, light_beginnings.value
        lengths = np.diff(pieces.offsets)
        own = np.repeat(np.arange(len(lengths)), lengths)
        starts = np.arange(len(own))
        left = pieces.offsets[1:][own] - starts
        hits, texts = [], []
        for step, longer in ladder(sizes):
            keep = left >= step
            starts, left, own = starts[keep], left[keep], own[keep]
            keep = in_bits(beginnings, pieces.hashes(starts, step))
            starts, left, own = starts[keep], left[keep], own[keep]
            for size in longer:
                fits = np.flatnonzero(left >= size)
                h = pieces.hashes(starts[fits], size)
                known = np.flatnonzero(in_bits(bits, h))
                hits.append(h[known])
                texts.append(own[fits[known]])
        return counted(np.concatenate(hits), np.concatenate(texts))

    def counted(h: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
        # a hash comes from one length, where texts are in order
        order = np.argsort(h, kind="stable")
        h, text = h[order], text[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1]))) if len(h) else np.zeros(0, bool)
        return summed(h[new], np.ones(int(new.sum()), np.int64))

    def summed(h: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        return [h[first], np.add.reduceat(n[order], first) if len(h) else n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for chunk in chunks(batches, "body"):
            held.append(found(chunk.filter(pc.is_valid(chunk.column("body")))))
            rows += len(held[-1][0])
            if rows >= 2 * HELD_HASHES:
                held = [summed(*[np.concatenate(x) for x in zip(*held)])]
                rows = len(held[0][0])
                if rows >= HELD_HASHES:
                    yield from slices(dict(zip(("h", "n"), held[0])))
                    held, rows = [], 0
        if held:
            yield from slices(dict(zip(("h", "n"), summed(*[np.concatenate(x) for x in zip(*held)]))))

    return run
