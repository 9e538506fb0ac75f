"""Benchmark decontamination: suffix arrays of training text, searched for every benchmark suffix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetlens.llm.arrays import RangeHash, chunks, lower_ascii, text_bytes, word_spans
from streetlens.llm.columns import as_row, row_type
from streetlens.session import stage_table

#: Benchmark text that is sent to the tasks at once; a larger benchmark is screened part by part.
MAX_BENCHMARK_BYTES = 128 << 20

#: Pairs of a hit and an item that a task holds at once.
PAIR_ROWS = 1 << 22

#: Benchmark suffixes looked up at once.
SEARCH_ROWS = 1 << 17

REPORT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
MATCHES = "item_id string, item_start bigint, doc_start bigint, n_words bigint"


def in_word() -> np.ndarray:
    """Bytes of a word: digits, a-z, and all of any character beyond ASCII."""
    table = np.zeros(256, bool)
    table[48:58] = table[97:123] = table[128:] = True
    return table


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z lower-cased, and the number of the first word of each text."""
    data, offsets = text_bytes(column)
    data = lower_ascii(data)
    starts, ends, first = word_spans(data, offsets, in_word())
    return RangeHash(data).of(starts, ends), first


class SuffixArray:
    """Suffixes of a shard of texts, sorted by their first ``depth`` words; none crosses its text.

    Built by doubling: ranks of prefixes of h words give those of 2h. Words are ordered by their hash,
    which serves as well as the alphabet for finding equal sequences.
    """

    def __init__(self, words: np.ndarray, first: np.ndarray, depth: int):
        n = len(words)
        self.vocabulary, rank = np.unique(words, return_inverse=True)
        self.words = rank = rank.astype(np.int64) + 1
        self.end = np.repeat(first[1:], np.diff(first))
        width = 1
        while width < depth:
            step = min(width, depth - width)
            behind = np.zeros(n, np.int64)
            at = np.arange(n) + step
            inner = at < self.end
            behind[inner] = rank[at[inner]]
            _, rank = np.unique(rank * np.int64(n + 2) + behind, return_inverse=True)
            rank = rank.astype(np.int64) + 1
            width += step
        self.order = np.argsort(rank, kind="stable")

    def symbol(self, place: np.ndarray, depth: int) -> np.ndarray:
        """Word at ``depth`` of the suffixes at these places of the array; 0 behind the end of the text."""
        at = self.order[place] + depth
        inner = at < self.end[self.order[place]]
        return np.where(inner, self.words[np.minimum(at, len(self.words) - 1)], 0)

    def bound(self, low: np.ndarray, high: np.ndarray, word: np.ndarray, depth: int, right: bool) -> np.ndarray:
        """Binary search for a word among the suffixes of each interval, which agree before ``depth``."""
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            seen = self.symbol(middle, depth)
            below = seen <= word[open_] if right else seen < word[open_]
            low[open_] = np.where(below, middle + 1, low[open_])
            high[open_] = np.where(below, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        return low

    def search(self, sequences: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each sequence of word hashes its longest match (in words, ``depth`` at most) and where it is.

        The interval of places of the array that hold the longest match: low, high, matched words.
        """
        m = len(lengths)
        low, high = np.zeros(m, np.int64), np.full(m, len(self.order), np.int64)
        matched = np.zeros(m, np.int64)
        alive = np.arange(m)
        for depth in range(int(lengths.max(initial=0))):
            alive = alive[lengths[alive] > depth]
            place = np.searchsorted(self.vocabulary, sequences[alive, depth])
            known = self.vocabulary[np.minimum(place, len(self.vocabulary) - 1)] == sequences[alive, depth]
            alive, word = alive[known], place[known] + 1
            left = self.bound(low[alive], high[alive], word, depth, right=False)
            right = self.bound(left, high[alive], word, depth, right=True)
            hit = left < right
            alive = alive[hit]
            if not len(alive):
                break
            low[alive], high[alive], matched[alive] = left[hit], right[hit], depth + 1
        return low, high, matched


def benchmark_windows(table: pa.Table, window: int) -> dict:
    """Windows of the benchmark: each distinct sequence of words once, with the places it comes from."""
    words, first = words_of(table.column("text"))
    counts = np.diff(first)
    names = table.column("item_id").fill_null("").to_pylist()
    n_windows = np.where(counts >= window, counts - window + 1, np.minimum(counts, 1))
    item = np.repeat(np.arange(len(counts)), n_windows)
    offset = np.arange(len(item)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    length = np.minimum(counts[item], window)
    at = first[item] + offset
    rows = np.zeros((len(item), window), np.uint64)
    for depth in range(window):
        inner = depth < length
        rows[inner, depth] = words[at[inner] + depth]
    begin = np.arange(len(item)) * window
    key = RangeHash(rows.ravel()).of(begin, begin + length)
    _, keep, group = np.unique(key, return_index=True, return_inverse=True)
    order = np.argsort(group, kind="stable")
    return {
        "names": names, "sequences": rows[keep], "lengths": length[keep], "item": item[order], "offset": offset[order],
        "first": np.searchsorted(group[order], np.arange(len(keep) + 1))}


def expand(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All values of the ranges, and which range each is of."""
    sizes = stops - starts
    which = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[which], which


def find(array: SuffixArray, benchmark: SimpleNamespace) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the shard at which whole windows occur, and the window of each."""
    positions, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start in range(0, len(benchmark.lengths), SEARCH_ROWS):
        lengths = benchmark.lengths[start:start + SEARCH_ROWS]
        low, high, matched = array.search(benchmark.sequences[start:start + SEARCH_ROWS], lengths)
        full = np.flatnonzero(matched == lengths)
        place, which = expand(low[full], high[full])
        positions.append(array.order[place])
        windows.append(full[which] + start)
    return np.concatenate(positions), np.concatenate(windows)


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def longest_matches(words: np.ndarray, first: np.ndarray, benchmark: SimpleNamespace, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The maximal common runs of a shard's texts and the items: document, item, start in each, words.

    Hits of the suffix array that follow one another in document and item are one match. They are paired with
    the items of their window some documents at a time, so that a passage of many items does not fill the task.
    """
    position, found = find(SuffixArray(words, first, window), benchmark)
    order = np.argsort(position, kind="stable")
    position, found = position[order], found[order]
    if not len(position):
        return
    doc = np.searchsorted(first, position, "right") - 1
    sizes = benchmark.first[found + 1] - benchmark.first[found]
    heads = np.flatnonzero(np.diff(doc, prepend=-1))
    blocks = (np.cumsum(sizes)[heads] - sizes[heads]) // PAIR_ROWS
    cuts = heads[np.flatnonzero(np.diff(blocks, prepend=-1))]
    for start, stop in zip(cuts, np.append(cuts[1:], len(position)), strict=True):
        window_of = found[start:stop]
        place, which = expand(benchmark.first[window_of], benchmark.first[window_of + 1])
        at, item, offset = position[start:stop][which], benchmark.item[place], benchmark.offset[place]
        order = np.lexsort((at, at - offset, item))
        at, item, offset, which = at[order], item[order], offset[order], which[order]
        of, length = doc[start:stop][which], benchmark.lengths[window_of][which]
        goes_on = np.zeros(len(at), bool)
        goes_on[1:] = (item[1:] == item[:-1]) & (at[1:] == at[:-1] + 1) & (offset[1:] == offset[:-1] + 1) & (of[1:] == of[:-1])
        head = np.flatnonzero(~goes_on)
        tail = np.append(head[1:], len(at)) - 1
        yield of[head], item[head], at[head] - first[of[head]], offset[head], at[tail] - at[head] + length[tail]


def hits(words: np.ndarray, first: np.ndarray, benchmark: SimpleNamespace, window: int) -> tuple[np.ndarray, dict[int, list[str]]]:
    """From the longest matches: which words are hit, and the sorted ids of the items of each document hit."""
    flags = np.zeros(len(words), bool)
    names: dict[int, list[str]] = {}
    if not len(words) or not len(benchmark.lengths):
        return flags, names
    for doc, item, at, _, length in longest_matches(words, first, benchmark, window):
        flags |= covered(len(words), first[doc] + at, length)
        n = len(benchmark.names)
        of, items = np.divmod(np.unique(doc * np.int64(n) + item), n)
        heads = np.flatnonzero(np.diff(of, prepend=-1))
        for start, stop in zip(heads, np.append(heads[1:], len(of)), strict=True):
            names[int(of[start])] = sorted({benchmark.names[i] for i in items[start:stop]})
    return flags, names


def reporter(sent, window: int, share: int):
    """Task: the longest matches of a shard's suffix array; one report per document, its row beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = SimpleNamespace(**sent.value)
        empty = hashlib.sha256(b"").hexdigest()
        for batch in chunks(batches, "text"):
            words, first = words_of(batch.column("text"))
            counts = np.diff(first)
            flags, names = hits(words, first, benchmark, window)
            hit = np.diff(np.concatenate(([0], np.cumsum(flags)))[first])
            items, digests = np.zeros(len(counts), np.int64), [empty] * len(counts)
            for doc, found in names.items():
                items[doc], digests[doc] = len(found), hashlib.sha256(",".join(found).encode()).hexdigest()
            yield pa.RecordBatch.from_pydict({
                "row": batch.column("row"), "n_words": counts, "n_hit": hit, "n_items": items,
                "items_sha256": digests, "contaminated": (hit > 0) & (share * hit >= counts)})

    return run


def counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: the rows with their texts and word counts."""
    for batch in chunks(batches, "text"):
        _, first = words_of(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(np.diff(first), pa.int64())], names=["row", "text", "n_words"])


def finder(sent, window: int):
    """Task: for the documents that share words with one part of the benchmark, the runs hit and the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = SimpleNamespace(**sent.value)
        for batch in chunks(batches, "text"):
            words, first = words_of(batch.column("text"))
            flags, names = hits(words, first, benchmark, window)
            if not names:
                continue
            runs = []
            for doc in names:
                edge = np.diff(flags[first[doc]:first[doc + 1]].astype(np.int8), prepend=0, append=0)
                pairs = zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)
                runs.append([{"start": int(a), "stop": int(b)} for a, b in pairs])
            yield pa.RecordBatch.from_arrays([
                batch.column("n").take(pa.array(list(names), pa.int64())),
                pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                pa.array(list(names.values()), pa.list_(pa.string()))], names=["n", "runs", "items"])

    return run


def matcher(sent, window: int):
    """Task: maximal verbatim matches of benchmark items, with their place in document and item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = SimpleNamespace(**sent.value)
        for batch in chunks(batches, "text"):
            words, first = words_of(batch.column("text"))
            if not len(words) or not len(benchmark.lengths):
                continue
            for doc, item, at, offset, length in longest_matches(words, first, benchmark, window):
                yield pa.RecordBatch.from_pydict({
                    "row": batch.column("row").take(pa.array(doc)), "item_id": [benchmark.names[i] for i in item],
                    "item_start": offset, "doc_start": at, "n_words": length})

    return run


def _parts(benchmark: DataFrame) -> list[DataFrame]:
    """The items in parts of at most ``MAX_BENCHMARK_BYTES``, dealt by hash; one part where all fit."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter(F.col("text").isNotNull())
    size = F.octet_length("text").cast("bigint")
    total, largest = items.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    if largest > MAX_BENCHMARK_BYTES:
        raise ValueError(f"an item of the benchmark has {largest} bytes, more than {MAX_BENCHMARK_BYTES}")
    n = -(-total // MAX_BENCHMARK_BYTES)
    while n > 1:
        dealt = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
        # equal items are one, so that the parts get smaller as they get more
        distinct = items.distinct()
        if distinct.groupBy(dealt).agg(F.sum(size).alias("size")).agg(F.max("size")).first()[0] <= MAX_BENCHMARK_BYTES:
            return [distinct.filter(dealt == part) for part in range(n)]
        n *= 2
    return [items]


def _send(items: DataFrame, window: int):
    return items.sparkSession.sparkContext.broadcast(benchmark_windows(items.toArrow(), window))


def _in_parts(rows: DataFrame, kind: str, parts: list[DataFrame], window: int, share: int) -> DataFrame:
    """The report where the benchmark is screened part by part: runs and items are united before the rule."""
    counted = rows.mapInArrow(counter, f"row {kind}, text string, n_words bigint")
    numbered = stage_table(counted.withColumn("n", F.monotonically_increasing_id()), "screened")
    found = []
    for part in parts:
        sent = _send(part, window)
        kinds = "n bigint, runs array<struct<start: bigint, stop: bigint>>, items array<string>"
        found.append(stage_table(numbered.select("n", "text").mapInArrow(finder(sent, window), kinds), "benchmark_part"))
        sent.destroy()
    united = reduce(DataFrame.union, found).groupBy("n").agg(
        F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    # words of the union of the runs, which come in the order of their starts
    begin = F.struct(F.lit(0).cast("bigint").alias("stop"), F.lit(0).cast("bigint").alias("words"))
    n_hit = F.aggregate("runs", begin, lambda seen, run: F.struct(
        F.greatest(seen.stop, run.stop).alias("stop"),
        (seen.words + F.greatest(F.lit(0).cast("bigint"), run.stop - F.greatest(seen.stop, run.start))).alias("words")), lambda seen: seen.words)
    summed = united.select("n", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.array_join(F.array_sort("items"), ",").alias("ids"))
    hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return numbered.drop("text").join(summed, "n", "left").select(
        "row", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"))


def _rows(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, str]:
    rows = docs.select(as_row(keep), "text")
    return rows, row_type(rows)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, keep: list[str] | None = None) -> DataFrame:
    """One report per document: ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.

    Words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII. A window is ``window``
    consecutive words of an item, or all words of a shorter one. A document's word inside any occurrence of
    a window is hit; a document is contaminated if ``share * n_hit >= n_words`` and a word is hit.
    ``items_sha256`` is over the sorted ids of the items found, joined by commas.

    Result: the struct ``row`` with the columns ``keep`` (default ``doc_id``) beside the report, so no column
    of the input can clash. A null text has no words and is clean; a null item text has no window; a null
    item id is written as an empty string; items of one id count once; repeated rows are reported each.
    Empty tables give an empty or an all-clean report.

    Each task sorts the suffixes of its own shard, searches all windows and joins what follows one another to
    the longest matches, from which hits and items come: no shuffle. A benchmark of up to ``MAX_BENCHMARK_BYTES``
    is sent to the tasks whole. A larger one is sent in parts, one after another, and the runs and items that
    each part finds are united per document before the rule is applied: the same report. A single item above
    that size is an error.
    """
    parts = _parts(benchmark)
    rows, kind = _rows(docs, keep or ["doc_id"])
    if len(parts) > 1:
        return _in_parts(rows, kind, parts, window, share)
    return rows.mapInArrow(reporter(_send(parts[0], window), window, share), f"row {kind}, {REPORT}")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    return contamination(docs, benchmark, window, share, docs.columns).filter(~F.col("contaminated")).select("row.*")


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, keep: list[str] | None = None) -> DataFrame:
    """The longest verbatim matches: ``row``, ``item_id``, ``item_start``, ``doc_start``, ``n_words``.

    A match is a maximal run of common words of at least a window; starts count words from 0. A benchmark in
    several parts is searched part by part; equal items of one id then count once.
    """
    rows, kind = _rows(docs, keep or ["doc_id"])
    found = [rows.mapInArrow(matcher(_send(part, window), window), f"row {kind}, {MATCHES}") for part in _parts(benchmark)]
    return reduce(DataFrame.union, found)
