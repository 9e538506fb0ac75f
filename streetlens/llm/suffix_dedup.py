"""Removal of repeated byte strings: anchored buckets, grouping by hash, a radix sort of what is left in a bucket."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetlens.llm.arrays import RangeHash, chunks, mixed, runs, signed, text_bytes
from streetlens.llm.columns import as_row, row_type
from streetlens.llm.components import maybe, value_filter
from streetlens.session import stage_table

#: Bytes of the gram that anchors a string, and of text a task works on at once.
GRAM, PIECE_BYTES = 40, 1 << 20

#: Windows of one bucket that are merged in one task; a larger bucket is cut by offsets, at last into single ones.
BUCKET_WINDOWS, CUTS = 256, (8, 1)

#: Windows that are merged side by side, buckets kept whole.
MERGE_ROWS = 1 << 14

WINDOW = "bucket bigint, window bigint, low int, high int, copies bigint, content binary"
REPEATED = "window bigint, low int, high int"


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Windows of a shard: runs of starts whose strings of ``length`` bytes have the same anchor.

    The anchor of a string is the gram in it with the smallest hash (the first of equals): it depends on the
    string alone, so equal strings have equal grams at equal offsets. ``at`` is the anchor's position, ``low`` and
    ``high`` are the least and the greatest offset of it from the starts of the run.
    """
    empty = {k: np.zeros(0, np.int64) for k in ("at", "low", "high", "bucket", "window")}
    sizes = np.diff(offsets)
    valid = np.flatnonzero(sizes >= length)
    if not len(valid):
        return empty
    hashes = RangeHash(data)
    gram = hashes.rolling(GRAM)
    width = length - GRAM + 1
    bits = np.uint64(max(1, len(gram).bit_length()))
    keys = np.full(-(-len(gram) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    keys[:len(gram)] = (gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64)
    blocks = keys.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    counts = sizes[valid] - length + 1
    starts = np.repeat(offsets[valid] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    least = np.minimum(behind[starts], ahead[starts + width - 1])
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    edge = np.flatnonzero(np.diff(at, prepend=-1))
    first, last, at = starts[edge], starts[np.append(edge[1:], len(starts)) - 1], at[edge]
    low, high = at - last, at - first
    window = mixed(hashes.of(first, last + length) ^ mixed(low.astype(np.uint64) + np.uint64(99)))
    return {"at": at, "low": low, "high": high, "bucket": gram[at], "window": window}


def surveyor(length: int):
    """Task: bucket and window of every run of starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", PIECE_BYTES):
            found = anchors(*text_bytes(batch.column("text")), length)
            yield pa.RecordBatch.from_pydict({
                "bucket": signed(found["bucket"].astype(np.uint64)), "window": signed(found["window"].astype(np.uint64))})

    return run


def collector(length: int, shared):
    """Task: windows of buckets that may be shared, with their bytes; copies in a shard are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", PIECE_BYTES):
            data, offsets = text_bytes(batch.column("text"))
            found = anchors(data, offsets, length)
            keep = np.flatnonzero(maybe(shared.value, found["bucket"].astype(np.uint64)))
            _, one, copies = np.unique(found["window"][keep], return_index=True, return_counts=True)
            keep = keep[one]
            begin, end = found["at"][keep] - found["high"][keep], found["at"][keep] - found["low"][keep] + length
            yield pa.RecordBatch.from_arrays([
                pa.array(signed(found["bucket"][keep].astype(np.uint64))), pa.array(signed(found["window"][keep].astype(np.uint64))),
                pa.array(found["low"][keep], pa.int32()), pa.array(found["high"][keep], pa.int32()), pa.array(copies),
                pa.array([data[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())],
                names=["bucket", "window", "low", "high", "copies", "content"])

    return run


def range_minimum(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minimum of ``values[left + 1 .. right]`` for each pair, ``left < right``."""
    out = values[right].copy()
    span = right - left
    wide = np.flatnonzero(span > 1)
    if len(wide):
        level, power, table = 0, 1, values
        log = np.frexp(span[wide].astype(float))[1] - 1
        for level in range(int(log.max()) + 1):
            here = wide[log == level]
            out[here] = np.minimum(table[left[here] + 1], table[right[here] - power + 1])
            table = np.minimum(table[:-power], table[power:]) if len(table) > power else table
            power *= 2
    return out


def merge(bucket: np.ndarray, low: np.ndarray, high: np.ndarray, copies: np.ndarray, content: list[bytes], length: int) -> np.ndarray:
    """For every offset (rows) and window (columns): does the string that starts there occur again?

    The windows of a bucket are aligned at their anchor and radix-sorted column by column from the right, from
    their bytes: no shard builds a transform and none are merged. A column deals the suffixes sorted so far out
    by the byte before them, in the order they have: then the suffixes that are one byte
    longer are sorted. No suffix is compared. The common prefix of two neighbours is one more than the
    least between them before, or nothing if their symbols differ; neighbours with ``length`` common bytes are
    a repeated interval.
    """
    reach = int(high.max()) + 1
    m = len(bucket)
    table = np.zeros((reach - 1 + length, m), np.uint8)
    for i, text in enumerate(content):
        begin = reach - 1 - high[i]
        table[begin:begin + len(text), i] = np.frombuffer(text, np.uint8)
    order = np.argsort(bucket, kind="stable")
    head = np.ones(m, bool)
    head[1:] = bucket[order][1:] != bucket[order][:-1]
    group = np.cumsum(head) - 1
    first = np.flatnonzero(head)[group]
    prefix = np.where(head, -1, 0).astype(np.int16)
    repeated = np.zeros((reach, m), bool)
    for row in range(reach - 2 + length, -1, -1):
        symbol = table[row][order]
        if np.array_equal(symbol, symbol[first]):
            prefix[~head] += 1
        else:
            dealt = np.argsort((group.astype(np.int64) << 32) | (symbol.astype(np.int64) << 24 | np.arange(m)))
            order, symbol = order[dealt], symbol[dealt]
            same = np.flatnonzero(~head & (symbol == np.concatenate(([0], symbol[:-1]))))
            longer = np.where(head, -1, 0).astype(np.int16)
            longer[same] = range_minimum(prefix, dealt[same - 1], dealt[same]) + 1
            prefix = longer
        np.minimum(prefix, length, out=prefix)
        offset = reach - 1 - row
        if offset >= 0:
            active = (low[order] <= offset) & (offset <= high[order])
            interval = np.cumsum(prefix < length) - 1
            many = np.bincount(interval, active)[interval] >= 2
            repeated[offset, order] = active & (many | (copies[order] >= 2))
    return repeated


def merger(length: int, large):
    """Task: repeated offsets of all windows of its buckets, except of those that may be too large."""

    def results(rows: pa.Table) -> pa.RecordBatch:
        bucket, window = rows.column("bucket").to_numpy(), rows.column("window").to_numpy()
        low, high = rows.column("low").to_numpy(), rows.column("high").to_numpy()
        flags = merge(bucket, low, high, rows.column("copies").to_numpy(), rows.column("content").to_pylist(), length)
        # one more offset that is never repeated ends the runs of each window
        begin, end = runs(np.concatenate((flags, np.zeros((1, len(low)), bool))).T.ravel())
        which = begin // (len(flags) + 1)
        return pa.RecordBatch.from_arrays([
            pa.array(window[which]), pa.array(begin - which * (len(flags) + 1), pa.int32()),
            pa.array(end - 1 - which * (len(flags) + 1), pa.int32())], names=["window", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if large is not None:
                batch = batch.filter(pa.array(~maybe(large.value, batch.column("bucket").to_numpy())))
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            while held.num_rows >= MERGE_ROWS:
                bucket = held.column("bucket").to_numpy()
                # the last bucket may go on in the next batch
                edges = np.flatnonzero(np.diff(bucket)) + 1
                stop = edges[edges <= MERGE_ROWS].max(initial=0) or edges[:1].max(initial=0)
                if not stop:
                    break
                yield results(held.slice(0, stop))
                held = held.slice(stop)
        if held is not None and held.num_rows:
            yield results(held)

    return run


def cutter(length: int, width: int, large):
    """Task: windows of buckets that may be too large, cut into pieces of ``width`` offsets.

    All strings of a piece have a core in common; pieces whose core differs have no string in common, so the
    core is the piece's bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(maybe(large.value, batch.column("bucket").to_numpy())))
            if not batch.num_rows:
                continue
            data, offsets = text_bytes(batch.column("content"))
            low, high = batch.column("low").to_numpy().astype(np.int64), batch.column("high").to_numpy().astype(np.int64)
            count = high // width - low // width + 1
            row = np.repeat(np.arange(len(low)), count)
            begin = (low[row] // width + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * width
            anchor = offsets[row] + high[row]
            hashes = RangeHash(data)
            core = hashes.of(anchor - begin, anchor - begin - width + 1 + length)
            bucket = mixed(core ^ mixed(batch.column("bucket").to_numpy().view(np.uint64)[row] + begin.astype(np.uint64) * np.uint64(0x1F) + np.uint64(width)))
            piece_low, piece_high = np.maximum(low[row], begin), np.minimum(high[row], begin + width - 1)
            start, stop = anchor - piece_high, anchor - piece_low + length
            window = mixed(hashes.of(start, stop) ^ mixed(bucket + (piece_low * 1000 + piece_high).astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([
                pa.array(signed(bucket)), pa.array(signed(window)), pa.array(piece_low, pa.int32()), pa.array(piece_high, pa.int32()),
                batch.column("copies").take(pa.array(row)),
                pa.array([data[a:b].tobytes() for a, b in zip(start.tolist(), stop.tolist(), strict=True)], pa.binary()),
                batch.column("window").take(pa.array(row))],
                names=["bucket", "window", "low", "high", "copies", "content", "owner"])

    return run


def locator(length: int, known):
    """Task: where in its documents the windows are that may have repeated strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", PIECE_BYTES):
            data, offsets = text_bytes(batch.column("text"))
            found = anchors(data, offsets, length)
            keep = np.flatnonzero(maybe(known.value, found["window"].astype(np.uint64)))
            at = found["at"][keep]
            text = np.searchsorted(offsets, at, "right") - 1
            yield pa.RecordBatch.from_arrays([
                batch.column("key").take(pa.array(text)), pa.array(signed(found["window"][keep].astype(np.uint64))),
                pa.array(at - offsets[text]), pa.array(found["low"][keep], pa.int32()), pa.array(found["high"][keep], pa.int32())],
                names=["key", "window", "at", "window_low", "window_high"])

    return run


def distinct_windows(rows: DataFrame) -> DataFrame:
    return rows.groupBy("window").agg(
        F.min("bucket").alias("bucket"), F.min("low").alias("low"), F.min("high").alias("high"),
        F.sum("copies").alias("copies"), F.min("content").alias("content")).select("bucket", "window", "low", "high", "copies", "content")


def repeated_windows(windows: DataFrame, length: int, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """``window``, ``low``, ``high``: runs of offsets of distinct windows whose strings occur more than once."""
    large = None
    if cuts:
        counts = windows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET_WINDOWS)
        large = value_filter(counts.select("bucket"))
    grouped = windows.repartition(F.col("bucket")).sortWithinPartitions("bucket", "window")
    found = grouped.mapInArrow(merger(length, large), REPEATED)
    if not cuts:
        return found
    pieces = stage_table(windows.mapInArrow(cutter(length, cuts[0], large), WINDOW + ", owner bigint"), "pieces")
    parts = repeated_windows(stage_table(distinct_windows(pieces), "windows"), length, cuts[1:])
    owners = pieces.select("window", "owner").join(stage_table(parts, "repeated"), "window")
    return found.union(owners.select(F.col("owner").alias("window"), "low", "high"))


def runs_by_window(found: DataFrame) -> DataFrame:
    """``window``, ``runs``: one row for each window, its runs of offsets in order; what touches or overlaps is one run.

    A window that was cut into pieces has a run for each of them. A place is joined to its window once, not to all of these.
    """
    def joined(done: Column, r: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["low"].alias("low"), F.greatest(last["high"], r["high"]).alias("high"))
        return F.when(last["high"] + 1 >= r["low"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(
            F.concat(done, F.array(r)))

    sorted_ = F.array_sort(F.collect_set(F.struct("low", "high")))
    none = F.array().cast("array<struct<low:int,high:int>>")
    return found.groupBy("window").agg(sorted_.alias("parts")).select("window", F.aggregate("parts", none, joined).alias("runs"))


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """``key``, ``spans`` (sorted begin and end of bytes in a repeated string, may touch or overlap) of documents
    that have any; ``docs`` has ``key`` and ``text``."""
    texts = docs.select("text")
    seen = texts.mapInArrow(surveyor(length), "bucket bigint, window bigint").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("window").alias("least"), F.max("window").alias("most"))
    seen = stage_table(seen.filter("n > 1"), "buckets")
    shared = value_filter(seen.filter("least <> most").select("bucket"))
    windows = stage_table(distinct_windows(texts.mapInArrow(collector(length, shared), WINDOW)), "windows")
    # a bucket whose windows are all equal is repeated as a whole
    whole = seen.filter("least = most").select(F.col("least").alias("window"), F.lit(0).alias("low"), F.lit(length).alias("high"))
    found = stage_table(whole.union(repeated_windows(windows, length)).distinct(), "repeated")
    places = docs.select("key", "text").mapInArrow(
        locator(length, value_filter(found.select("window"))), "key bigint, window bigint, at bigint, window_low int, window_high int")
    low, high = (lambda r: F.greatest(r["low"], F.col("window_low"))), (lambda r: F.least(r["high"], F.col("window_high")))
    spans = F.transform(F.filter("runs", lambda r: low(r) <= high(r)), lambda r: F.struct(
        (F.col("at") - high(r)).alias("begin"), (F.col("at") - low(r) + length).alias("end")))
    placed = places.join(runs_by_window(found), "window").select("key", spans.alias("spans")).filter(F.size("spans") > 0)
    return placed.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def remover(cut_text: bool):
    """Task: what is left of each document, its digest, and what was taken out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            spans = batch.column("spans").fill_null([])
            text = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(spans.offsets)))
            flat = spans.flatten()
            change = np.zeros(len(data) + 1, np.int64)
            np.add.at(change, offsets[text] + flat.field("begin").to_numpy(zero_copy_only=False), 1)
            np.add.at(change, offsets[text] + flat.field("end").to_numpy(zero_copy_only=False), -1)
            gone = np.cumsum(change[:-1]) > 0
            total = np.concatenate(([0], np.cumsum(gone)))
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            opens[offsets[:-1][offsets[:-1] < len(data)]] = gone[offsets[:-1][offsets[:-1] < len(data)]]
            spans_before = np.concatenate(([0], np.cumsum(opens)))
            digests, texts = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                digests.append(hashlib.sha256(data[a:b][~gone[a:b]].tobytes()).hexdigest())
                if cut_text:
                    texts.append(whole_signs(data[a:b], gone[a:b]))
            columns = {
                "row": batch.column("row"), "n_bytes": np.diff(offsets), "n_removed": np.diff(total[offsets]),
                "n_spans": np.diff(spans_before[offsets]), "kept_sha256": digests}
            if cut_text:
                columns["kept_text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def whole_signs(data: np.ndarray, gone: np.ndarray) -> str:
    """Text without the signs of which all bytes are gone; a sign that is cut through stays."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(lead):
        return ""
    sizes = np.diff(np.append(lead, len(data)))
    return data[np.repeat(~np.logical_and.reduceat(gone, lead), sizes)].tobytes().decode()


def without_repeats(docs: DataFrame, length: int = 200, keep: list[str] | None = None, cut_text: bool = False) -> DataFrame:
    """Documents without bytes covered by a string of ``length`` bytes that starts anywhere else, too.

    Result: the struct ``row`` with the columns ``keep`` (default ``doc_id``), so nothing can clash, beside ``n_bytes``,
    ``n_removed``, ``n_spans`` (maximal runs of removed bytes), ``kept_sha256`` (of the bytes that are left) and, with
    ``cut_text``, ``kept_text`` (signs are left out when all their bytes are). Strings are of UTF-8 bytes, never cross
    documents, may overlap, and are judged on the input: every occurrence goes, the first as well. A null text is
    empty; repeated rows are copies and lose what is long enough; an empty table stays empty.

    Every string belongs to the bucket of its anchor gram. Runs of strings with one anchor form a window, and
    equal windows are one with its copies counted. Windows of a bucket, from whatever shards, are merged by
    ``merge``. A bucket with more than ``BUCKET_WINDOWS`` distinct windows is cut by offsets into pieces that can
    be merged apart, at last into single strings, so that no task holds a very common one.
    """
    marked = docs.select(as_row(keep or ["doc_id"]), F.xxhash64("doc_id", "text").alias("key"), "text")
    spans = repeated_spans(marked, length)
    kind = row_type(marked)
    result = f"row {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_text string" * cut_text
    return marked.join(spans, "key", "left").select("row", "text", "spans").mapInArrow(remover(cut_text), result)


def deduplicated(docs: DataFrame, length: int = 200) -> DataFrame:
    """Documents with the repeated strings cut out of ``text`` and ``n_chars`` counted anew; all columns stay.

    A document of which nothing is left stays with an empty text.
    """
    cut = without_repeats(docs, length, docs.columns, cut_text=True)
    new = {"text": F.when(F.col("row.text").isNotNull(), F.col("kept_text")), "n_chars": F.length("kept_text").cast("bigint")}
    return cut.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])
