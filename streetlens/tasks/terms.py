"""Words and word pairs of cleaned texts as 64-bit hashes, counted by text in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text counted at once (a longer text is taken alone), and different terms a task holds before it gives them out.
CHUNK_BYTES, HELD_TERMS = 2 << 20, 1 << 20
#: Upper bits of a hash that tell its part: terms are exchanged by part, a task holds one or a few at a time.
PART_BITS = 14

# what cleaning makes of each byte: a letter, a space, or 0 for nothing
_CLEAN = np.zeros(256, np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)
_CLEAN[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 32
# signs beyond ASCII that leave something: wide white space, and those whose lower case holds an ASCII letter
_WIDE = {c: " " for c in [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]} | {0x130: "i", 0x212A: "k"}
_WIDE_BYTES = [(np.frombuffer(chr(c).encode(), np.uint8), ord(left)) for c, left in _WIDE.items()]


def cleaned(texts: pa.Array) -> pa.Array:
    """Texts as ``functions.text.clean_text`` leaves them, but for repeated spaces; a null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    out = np.frombuffer(bytearray(raw).translate(_CLEAN.tobytes()), np.uint8)
    leads = np.flatnonzero(raw >= 0xC2)
    if len(leads):
        padded = np.concatenate((raw, np.zeros(3, np.uint8)))
        lead = raw[leads]
        for sign, left in _WIDE_BYTES:
            here = leads[lead == sign[0]]
            for i in range(1, len(sign)):
                here = here[padded[here + i] == sign[i]]
            out[here] = left
    keep = out != 0
    ends = np.concatenate(([0], np.cumsum(keep)))[at - at[0]]
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out[keep])])


def chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scramble of 64-bit values."""
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Terms:
    """Different terms of each text of a chunk: number of the text, word (and second word, or -1), hash, count."""

    own: np.ndarray
    first: np.ndarray
    second: np.ndarray
    hash: np.ndarray
    n: np.ndarray
    words: pa.Array

    def names(self, at: np.ndarray) -> list[str]:
        words = self.words.to_pylist()
        return [words[a] if b < 0 else f"{words[a]} {words[b]}" for a, b in zip(self.first[at].tolist(), self.second[at].tolist())]


def terms_of(texts: pa.Array, stops: pa.Array) -> Terms:
    """Words of two letters or more that are no stop words, and the pairs of what is left, counted by text."""
    lists = pc.split_pattern(cleaned(texts), " ")
    encoded = lists.flatten().dictionary_encode()
    words = encoded.dictionary
    good = pc.and_(pc.greater_equal(pc.utf8_length(words), 2), pc.invert(pc.is_in(words, value_set=stops.cast(words.type)))).to_numpy(zero_copy_only=False)
    own = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    ids = encoded.indices.to_numpy().astype(np.int64)
    kept = good[ids] if len(ids) else np.zeros(0, bool)
    own, ids = own[kept], ids[kept]
    size = max(1, len(words))
    single, single_n = np.unique(own * size + ids, return_counts=True)
    beside = own[1:] == own[:-1]
    pair, pair_n = np.unique((own[1:] * size + ids[:-1])[beside] * size + ids[1:][beside], return_counts=True)
    hashes = pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(words) else np.zeros(0, np.uint64)
    a, b = pair // size % size, pair % size
    pair_hash = mixed(hashes[a] * np.uint64(0x9E3779B97F4A7C15) + mixed(hashes[b] + np.uint64(1)))
    return Terms(
        np.concatenate((single // size, pair // size // size)), np.concatenate((single % size, a)),
        np.concatenate((np.full(len(single), -1), b)), np.concatenate((hashes[single % size], pair_hash)).view(np.int64),
        np.concatenate((single_n, pair_n)), words)


def _summed(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Different hashes in order, and the sums of their other columns."""
    order = np.argsort(columns[0])
    h = columns[0][order]
    starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return [h[starts], *[np.add.reduceat(c[order], starts) if len(h) else c for c in columns[1:]]]


def _frequencies(batches: Iterator[pa.RecordBatch], stop_words: pa.Array, with_totals: bool) -> Iterator[list[np.ndarray]]:
    """``h``, ``df`` (, ``total``) of the terms of some texts, in order of ``h``; a term comes again with later texts."""
    def counted() -> list[np.ndarray]:
        columns = [np.concatenate(x) for x in zip(*fresh)]
        if with_totals:
            found = _summed([columns[0], np.ones(len(columns[0]), np.int64), columns[1]])
        else:
            found = list(np.unique(columns[0], return_counts=True))
        return _summed([np.concatenate(x) for x in zip(held, found)]) if held else found

    fresh, held, rows = [], [], 0
    for chunk in chunks(batches, "body"):
        t = terms_of(chunk.column("body"), stop_words)
        if not len(t.hash):
            continue
        fresh.append([t.hash, t.n] if with_totals else [t.hash])
        rows += len(t.hash)
        if rows >= 2 * HELD_TERMS:
            held, fresh = counted(), []
            rows = len(held[0])
            if rows >= HELD_TERMS:
                yield held
                held, rows = [], 0
    if fresh:
        yield counted()
    elif held:
        yield held


def frequency_counter(stops: list[str], with_totals: bool):
    """Task: texts to (h, df, total): in how many of its texts each term stands, and how often in all."""
    stop_words = pa.array(stops, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _frequencies(batches, stop_words, with_totals):
            yield from slices(dict(zip(("h", "df", "total"), found)))

    return run


def frequency_packer(stops: list[str], with_totals: bool):
    """Task: as ``frequency_counter``, with one row for each part of the hashes: its number, and the bytes of its columns."""
    stop_words = pa.array(stops, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _frequencies(batches, stop_words, with_totals):
            parts = found[0] >> 64 - PART_BITS
            starts = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1])))
            ends = pa.py_buffer((np.append(starts, len(parts)) * 8).astype(np.int32))
            packed = [pa.Array.from_buffers(pa.binary(), len(starts), [None, ends, pa.py_buffer(c.astype(np.int64, copy=False))]) for c in found]
            yield pa.RecordBatch.from_arrays([pa.array(parts[starts].astype(np.int32)), *packed], ["part", "h", "df", "total"][:len(found) + 1])

    return run


def frequency_merger(least: int):
    """Task: rows of ``frequency_packer`` in order of their part to (h, df, total) of the terms in ``least`` texts or more."""
    def unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
        found = []
        for column in batch.columns[1:]:
            _, offsets, data = column.buffers()
            at = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1] // 8 if len(column) else [0, 0]
            found.append(np.frombuffer(data, np.int64, at[-1])[at[0]:] if at[-1] else np.zeros(0, np.int64))
        return found

    def merged(held: list[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
        found = _summed([np.concatenate(x) for x in zip(*held)])
        often = found[1] >= least
        if often.any():
            yield from slices(dict(zip(names, [c[often] for c in found])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, names = [], None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            names, parts = batch.schema.names[1:], batch.column("part").to_numpy()
            # the last part may go on in the next batch
            stop = int(np.searchsorted(parts, parts[-1]))
            if stop or parts[-1] != last:
                yield from merged([*held, unpacked(batch.slice(0, stop))], names)
                held, last = [], parts[-1]
            held.append(unpacked(batch.slice(stop)))
        if held:
            yield from merged(held, names)

    return run


def slices(columns: dict[str, np.ndarray], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    length = len(next(iter(columns.values())))
    for start in range(0, length, rows):
        yield pa.RecordBatch.from_pydict({name: pa.array(values[start:start + rows]) for name, values in columns.items()})


def in_bits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in a bit map (its size is a power of two)."""
    at = h & np.int64(len(bits) * 8 - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def find(hashes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``h`` are in the sorted ``hashes``, and where those stand; looked up in order, which spares the cache."""
    if not len(hashes):
        return np.zeros(len(h), bool), np.zeros(0, np.int64)
    order = np.argsort(h)
    at = np.empty(len(h), np.int64)
    at[order] = np.minimum(np.searchsorted(hashes, h[order]), len(hashes) - 1)
    known = hashes[at] == h
    return known, at[known]


def weigher(stops: list[str], frequent, light_bits, scored: int):
    """Task: texts to what their weights need.

    ``frequent`` (broadcast) holds the sorted hashes of the most frequent terms, their numbers by falling frequency and
    the idf by number. Result: the sum of squared weights over those, the numbers below ``scored`` with their counts,
    and the hashes that may be rarer terms of the vocabulary, with theirs.
    """
    stop_words = pa.array(stops, pa.string())

    def lists(own: np.ndarray, rows: int, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(np.searchsorted(own, np.arange(rows + 1)).astype(np.int32), pa.array(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, numbers, idf = frequent.value
        bits = None if light_bits is None else light_bits.value
        for chunk in chunks(batches, "body"):
            t, rows = terms_of(chunk.column("body"), stop_words), chunk.num_rows
            order = np.argsort(t.own, kind="stable")
            own, h, n = t.own[order], t.hash[order], t.n[order]
            known, at = find(hashes, h)
            number = numbers[at]
            weight = n[known] * idf[number]
            top = number < scored
            rare = np.zeros(len(h), bool) if bits is None else ~known & in_bits(bits, h)
            yield pa.RecordBatch.from_arrays([
                chunk.column("text_no"), pa.array(np.bincount(own[known], weight * weight, rows).astype(float)),
                lists(own[known][top], rows, number[top].astype(np.int32)), lists(own[known][top], rows, n[known][top].astype(np.int32)),
                lists(own[rare], rows, h[rare]), lists(own[rare], rows, n[rare].astype(np.int32)),
            ], ["text_no", "squares", "numbers", "counts", "rare", "rare_counts"])

    return run


def scorer(frequent, scored: int):
    """Task: (norm, numbers, counts) of texts to the sum of unit-length weights of each number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = frequent.value[2]
        total = np.zeros(scored)
        for batch in batches:
            numbers = batch.column("numbers").flatten().to_numpy()
            norm = np.repeat(batch.column("norm").to_numpy(zero_copy_only=False), np.diff(np.asarray(batch.column("numbers").offsets)))
            total += np.bincount(numbers, batch.column("counts").flatten().to_numpy() * idf[numbers] / norm, scored)
        used = np.flatnonzero(total)
        yield from slices({"number": used.astype(np.int32), "weight": total[used]})

    return run


def namer(stops: list[str], bits, wanted=None):
    """Task: texts to (h, term) of the terms whose hash may be in a bit map, each once a task.

    With ``wanted`` (broadcast, sorted) only of those hashes; a task that has named all of them looks no further.
    """
    stop_words = pa.array(stops, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for chunk in chunks(batches, "body"):
            if wanted is not None and len(seen) == len(wanted.value):
                continue
            t = terms_of(chunk.column("body"), stop_words)
            at = np.flatnonzero(in_bits(bits.value, t.hash))
            if wanted is not None:
                at = at[find(wanted.value, t.hash[at])[0]]
            h, first = np.unique(t.hash[at], return_index=True)
            new = ~np.isin(h, seen)
            if new.any():
                yield pa.RecordBatch.from_pydict({"h": h[new], "term": t.names(at[first[new]])})
                # beyond this many the task forgets: a name may then come twice
                seen = np.union1d(seen, h[new]) if wanted is not None or len(seen) < HELD_TERMS else h

    return run


@dataclass
class Tokens:
    """Cleaned words of some texts, in order: number of the text, number of the word, and the different words."""

    own: np.ndarray
    ids: np.ndarray
    words: pa.Array


def tokens_of(texts: pa.Array) -> Tokens:
    lists = pc.split_pattern(cleaned(texts), " ")
    encoded = lists.flatten().dictionary_encode()
    own = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    ids = encoded.indices.to_numpy().astype(np.int64)
    kept = pc.not_equal(encoded.dictionary, "").to_numpy(zero_copy_only=False)[ids] if len(ids) else np.zeros(0, bool)
    return Tokens(own[kept], ids[kept], encoded.dictionary.cast(pa.string()))


def most_common(own: np.ndarray, terms: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` most frequent terms of each text, first come first on ties, and where each text begins among them."""
    order = np.lexsort((terms, own))
    a, b = own[order], terms[order]
    starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
    n = np.diff(np.append(starts, len(a)))
    # the sort is stable: the first of equal terms is the one that came first
    first, a, b = order[starts], a[starts], b[starts]
    rank = np.lexsort((first, -n, a))
    a, b = a[rank], b[rank]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    a, b = a[place < k], b[place < k]
    return b, np.searchsorted(a, np.arange(rows + 1)).astype(np.int32)


class Words:
    """Word list sent to tasks: which words are in it, and their values."""

    def __init__(self, words: list[str], values: list[float] | None = None):
        self.words, self.values = pa.array(words, pa.string()), None if values is None else np.append(np.array(values, float), 0.0)

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which words are listed, and the values of all (0 for others)."""
        if not len(self.words):
            return np.zeros(len(words), bool), np.zeros(len(words))
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False)
        return at >= 0, np.zeros(len(words)) if self.values is None else self.values[at]


class HashedWords:
    """As ``Words``, from a broadcast of sorted 64-bit hashes of the words and their values."""

    def __init__(self, sent):
        self.sent = sent

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        hashes, values = self.sent.value
        if not len(hashes):
            return np.zeros(len(words), bool), np.zeros(len(words))
        h = word_hashes(words)
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        known = hashes[at] == h
        return known, np.zeros(len(words)) if values is None else np.where(known, values[at], 0.0)


def word_hashes(words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.int64)
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False).view(np.int64)


def word_hasher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: words, with or without a value, to their hashes."""
    for batch in batches:
        rest = {name: batch.column(name) for name in batch.schema.names if name != "word"}
        yield pa.RecordBatch.from_pydict({"h": word_hashes(batch.column("word").cast(pa.string())), **rest})


def word_lister(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: texts to their different cleaned words, each once a task while it holds them."""
    seen = pa.array([], pa.string())
    for chunk in chunks(batches, "body"):
        words = tokens_of(chunk.column("body")).words
        new = words.filter(pc.and_(pc.not_equal(words, ""), pc.invert(pc.is_in(words, value_set=seen))))
        if len(new):
            yield pa.RecordBatch.from_arrays([new], ["word"])
            # beyond this many the task forgets: a word may then come twice
            seen = pa.concat_arrays([seen, new]) if len(seen) < HELD_TERMS else new


def scored(texts: pa.Array, lexicon: Words | HashedWords) -> pa.StructArray:
    """``total`` and ``hits``: valences of the words of each text that are in a lexicon, and how many they are."""
    t, rows = tokens_of(texts), len(texts)
    known, value = lexicon.of(t.words)
    return pa.StructArray.from_arrays(
        [pa.array(np.bincount(t.own, value[t.ids], rows).astype(float)), pa.array(np.bincount(t.own, known[t.ids], rows).astype(np.int64))], ["total", "hits"])


def enriched(texts: pa.Array, stops: Words | HashedWords, lexicon: Words | HashedWords, max_keywords: int, max_phrases: int) -> pa.StructArray:
    """``total``, ``hits`` (valences of the words of a lexicon), ``keywords`` and ``phrases`` of each text."""
    t, rows = tokens_of(texts), len(texts)
    size = max(1, len(t.words))
    length = pc.utf8_length(t.words).to_numpy(zero_copy_only=False)
    free = ~stops.of(t.words)[0]
    known, value = lexicon.of(t.words)
    total, hits = np.bincount(t.own, value[t.ids], rows).astype(float), np.bincount(t.own, known[t.ids], rows).astype(np.int64)
    good = (free & (length >= 3))[t.ids]
    word, word_at = most_common(t.own[good], t.ids[good], rows, max_keywords)
    a, b = t.ids[:-1], t.ids[1:]
    good = (t.own[:-1] == t.own[1:]) & free[a] & free[b] & (length[a] + length[b] + 1 >= 6)
    pair, pair_at = most_common(t.own[:-1][good], a[good] * size + b[good], rows, max_phrases)
    phrases = pc.binary_join_element_wise(t.words.take(pa.array(pair // size)), t.words.take(pa.array(pair % size)), " ")
    return pa.StructArray.from_arrays([
        pa.array(total), pa.array(hits), pa.ListArray.from_arrays(word_at, t.words.take(pa.array(word))),
        pa.ListArray.from_arrays(pair_at, phrases)], ["total", "hits", "keywords", "phrases"])


def word_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: texts to (h, n): how often each cleaned word stands in its texts."""
    held, rows = [], 0

    def merged() -> list[np.ndarray]:
        h, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h, kind="stable")
        h = h[order]
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        return [h[starts], np.add.reduceat(n[order], starts) if len(h) else n]

    for chunk in chunks(batches, "body"):
        t = tokens_of(chunk.column("body"))
        n = np.bincount(t.ids, minlength=len(t.words)).astype(np.int64)
        held.append([word_hashes(t.words)[n > 0], n[n > 0]])
        rows += len(held[-1][0])
        if rows >= 2 * HELD_TERMS:
            held = [merged()]
            rows = len(held[0][0])
            if rows >= HELD_TERMS:
                yield from slices(dict(zip(("h", "n"), held[0])))
                held, rows = [], 0
    if held:
        yield from slices(dict(zip(("h", "n"), merged())))


def scored_with_rest(texts: pa.Array, lexicon: HashedWords, rest) -> pa.StructArray:
    """As ``scored``, with the hashes of the other words that a bit map may hold (``rest``) and their counts (``counts``)."""
    t, rows = tokens_of(texts), len(texts)
    known, value = lexicon.of(t.words)
    hashes = word_hashes(t.words)
    open_ = (~known & in_bits(rest.value, hashes))[t.ids]
    size = max(1, len(t.words))
    found, n = np.unique(t.own[open_] * size + t.ids[open_], return_counts=True)
    at = np.searchsorted(found // size, np.arange(rows + 1)).astype(np.int32)
    return pa.StructArray.from_arrays([
        pa.array(np.bincount(t.own, value[t.ids], rows).astype(float)), pa.array(np.bincount(t.own, known[t.ids], rows).astype(np.int64)),
        pa.ListArray.from_arrays(at, pa.array(hashes[found % size])), pa.ListArray.from_arrays(at, pa.array(n.astype(np.int64)))],
        ["total", "hits", "rest", "counts"])


def by_chunks(work, *others):
    """Arrow function of a column of texts, in pieces of ``CHUNK_BYTES``."""
    def run(texts: pa.Array) -> pa.Array:
        batch = pa.record_batch([texts], ["body"])
        found = [work(c.column("body"), *others) for c in chunks(iter([batch]), "body")]
        return pa.concat_arrays(found or [work(texts, *others)])

    return run
