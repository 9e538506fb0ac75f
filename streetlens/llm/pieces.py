"""SentencePiece encoding and decoding by streaming Viterbi."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetlens.llm.arrays import RangeHash, chunks, mixed, text_bytes
from streetlens.llm.columns import as_row, row_type

#: Segments of up to so many bytes are solved side by side; longer ones stream alone.
LANE_BYTES = 32

#: Distinct segments whose ids a task remembers.
KNOWN_SEGMENTS = 1 << 20

NONE = np.int64(-(1 << 60))


class Pieces:
    """Vocabulary of a SentencePiece model: piece bytes (a word mark is a space), integer scores, byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.raw = [b""] * size
        self.byte_ids = np.zeros(256, np.int32)
        self.by_bytes: dict[bytes, tuple[int, int]] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.raw[i] = bytes([int(piece[3:5], 16)])
                self.byte_ids[self.raw[i][0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.raw[i] = piece.replace("▁", " ").encode()
                self.by_bytes[self.raw[i]] = (i, round(model.get_score(i)))
        self.width = max(map(len, self.by_bytes))
        self.unknown = min(score for _, score in self.by_bytes.values()) - 10
        sizes = np.fromiter(map(len, self.raw), np.int64, size)
        self.sizes, self.begin, self.flat = sizes, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(self.raw), np.uint8)
        # a segment ends before a space that follows another sign, and around signs that no longer piece holds
        if any(b" " in p.lstrip(b" ") for p in self.by_bytes):
            raise ValueError("pieces that go on after a word mark are not supported")
        self.solo = np.ones(256, bool)
        self.solo[128:] = False
        for piece in self.by_bytes:
            if len(piece) > 1:
                self.solo[np.frombuffer(piece, np.uint8)] = False
        keys = RangeHash(self.flat).of(self.begin, self.begin + sizes)
        ids = np.array(sorted(i for i, _ in self.by_bytes.values()))
        order = ids[np.argsort(keys[ids])]
        self.keys, self.ids = keys[order], order
        scores = dict(self.by_bytes.values())
        self.scores = np.array([scores[i] for i in order.tolist()], np.int64)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.keys >> np.uint64(42)] = True

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in the sorted vocabulary, -1 where there is no such piece."""
        out = np.full(len(keys), -1, np.int64)
        some = np.flatnonzero(self.maybe[keys >> np.uint64(42)])
        place = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        good = self.keys[place] == keys[some]
        out[some[good]] = place[good]
        return out


def char_length(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


def stream(pieces: Pieces, data: bytes) -> Iterator[int]:
    """Ids of one segment of any length, given out as soon as they are certain.

    ``score`` and ``back`` are kept only for the boundaries behind the last committed one, scores only for
    the window of the longest piece: no later piece starts before it. When the best paths to all boundaries
    of the window leave the committed boundary by the same piece, that piece is certain and is given out.
    Ties go to the path whose last piece is longer.
    """
    n, reach = len(data), max(pieces.width, 4)
    score, back, lead = {0: 0}, {}, {}
    committed = 0

    def ids(start: int, end: int) -> Iterator[int]:
        known = pieces.by_bytes.get(data[start:end])
        return iter([known[0]]) if known else map(int, pieces.byte_ids[np.frombuffer(data[start:end], np.uint8)])

    for end in range(1, n + 1):
        if end < n and data[end] & 0xC0 == 0x80:
            continue
        best = None
        for start in range(max(0, end - reach), end):
            if start not in score:
                continue
            known = pieces.by_bytes.get(data[start:end])
            if known is None and char_length(data[start]) < end - start:
                continue
            value = score[start] + (known[1] if known else pieces.unknown)
            if best is None or value > best[0]:
                best = value, start
        score[end], back[end] = best
        lead[end] = end if back[end] == committed else lead[back[end]]
        score = {p: s for p, s in score.items() if p > end - reach}
        window = list(score)
        while committed not in window and len({lead[p] for p in window}) == 1:
            at = lead[end]
            yield from ids(committed, at)
            # the rest of each path now starts at the boundary just committed
            back = {p: b for p, b in back.items() if p > at}
            committed = at
            lead = {at: at}
            for p, b in back.items():
                if b == at:
                    lead[p] = p
                elif b in lead:
                    lead[p] = lead[b]
            back = {p: b for p, b in back.items() if p in lead}
    path, at = [], n
    while at > committed:
        path.append(at)
        at = back[at]
    for end in reversed(path):
        yield from ids(at, end)
        at = end


def lanes(pieces: Pieces, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentation of many short segments, one step for all of a length at once: ids and their counts.

    Each segment begins and ends at a boundary that every path passes, so the paths converge there and the
    segment's ids are committed.
    """
    width = min(pieces.width, LANE_BYTES)
    hashes = RangeHash(flat)
    at = np.arange(len(flat))
    left = np.full(len(flat), -1, np.int64)
    for_lane = np.repeat(np.arange(len(starts)), sizes)
    inner = np.arange(len(for_lane)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = starts[for_lane] + inner
    left[place] = sizes[for_lane] - inner
    begins = (flat & 0xC0) != 0x80
    value = np.full((len(flat), width), NONE, np.int64)
    found = np.full((len(flat), width), -1, np.int32)
    for l in range(1, width + 1):
        rows = at[(left >= l) & begins]
        if not len(rows):
            break
        hit = pieces.find(hashes.of(rows, rows + l))
        rows, hit = rows[hit >= 0], hit[hit >= 0]
        value[rows, l - 1] = pieces.scores[hit]
        found[rows, l - 1] = pieces.ids[hit]
    # a sign that is no piece itself is spelled in byte pieces
    rows = at[(left > 0) & begins]
    signs = np.select([flat[rows] < 0xC0, flat[rows] < 0xE0, flat[rows] < 0xF0], [1, 2, 3], 4)
    signs = np.minimum(signs, left[rows])
    bare = found[rows, signs - 1] < 0
    value[rows[bare], signs[bare] - 1] = pieces.unknown
    counts = np.zeros(len(starts), np.int64)
    results = []
    for n in np.unique(sizes):
        group = np.flatnonzero(sizes == n)
        base = starts[group]
        best = np.full((len(group), n + 1), NONE, np.int64)
        back = np.zeros((len(group), n + 1), np.int64)
        best[:, 0] = 0
        for end in range(1, n + 1):
            for l in range(min(width, end), 0, -1):
                score = best[:, end - l] + value[base + end - l, l - 1]
                better = score > best[:, end]
                best[better, end] = score[better]
                back[better, end] = l
        # walk back from the end; ids come in reverse order
        pos = np.full(len(group), n)
        rows_, steps = np.arange(len(group)), []
        while len(rows_):
            l = back[rows_, pos[rows_]]
            start = pos[rows_] - l
            steps.append((rows_, start, l))
            pos[rows_] = start
            rows_ = rows_[start > 0]
        row = np.concatenate([s[0] for s in steps])
        start = np.concatenate([s[1] for s in steps])
        l = np.concatenate([s[2] for s in steps])
        order = np.lexsort((start, row))
        row, start, l = row[order], start[order], l[order]
        ids = found[base[row] + start, l - 1]
        width_out = np.where(ids < 0, l, 1)
        spelled = np.repeat(ids, width_out)
        which = np.repeat(np.arange(len(ids)), width_out)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(width_out) - width_out, width_out)
        bytes_ = pieces.byte_ids[flat[base[row[which]] + start[which] + offset]]
        spelled = np.where(spelled < 0, bytes_, spelled)
        counts[group] = np.bincount(row[which], minlength=len(group))
        results.append((group, spelled))
    # back into the order of the segments
    begin = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.int32)
    for group, spelled in results:
        sizes_ = counts[group]
        inner = np.arange(len(spelled)) - np.repeat(np.cumsum(sizes_) - sizes_, sizes_)
        out[np.repeat(begin[group], sizes_) + inner] = spelled
    return out, counts


class Segments:
    """Encoder of a task: segments of the texts, each distinct one solved once."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.forget()

    def forget(self) -> None:
        self.keys, self.begin, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, keys: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        ids, counts = [self.ids], [self.count]
        short = sizes <= LANE_BYTES
        order = np.concatenate((np.flatnonzero(short), np.flatnonzero(~short)))
        edges = np.flatnonzero(short)
        for a in range(0, len(edges), 1 << 14):
            rows = edges[a:a + (1 << 14)]
            size = sizes[rows]
            begin = np.cumsum(size) - size
            place = np.repeat(starts[rows] - begin, size) + np.arange(int(size.sum()))
            found, count = lanes(self.pieces, flat[place], begin, size)
            ids.append(found)
            counts.append(count)
        for row in np.flatnonzero(~short):
            one = np.fromiter(stream(self.pieces, flat[starts[row]:starts[row] + sizes[row]].tobytes()), np.int32)
            ids.append(one)
            counts.append(np.array([len(one)]))
        keys = np.concatenate((self.keys, keys[order]))
        self.ids, count = np.concatenate(ids), np.concatenate(counts)
        begin = np.cumsum(count) - count
        by_key = np.argsort(keys)
        # ids stay where they are: lists of keys point into them
        self.keys, self.begin, self.count = keys[by_key], begin[by_key], count[by_key]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts and their counts; the marked bytes that were encoded and the offsets of the texts."""
        data, offsets = text_bytes(column)
        full = np.diff(offsets) > 0
        marked = np.ones(len(data) + int(full.sum()), bool)
        edges = offsets + np.concatenate(([0], np.cumsum(full)))
        marked[edges[:-1][full]] = False
        flat = np.full(len(marked), 32, np.uint8)
        flat[marked] = data
        if not len(flat):
            return np.zeros(0, np.int32), np.zeros(len(column), np.int64), flat, edges
        cut = np.zeros(len(flat) + 1, bool)
        space, solo = flat == 32, self.pieces.solo[flat] & (flat != 32)
        cut[1:-1] = space[1:] & ~space[:-1]
        cut[:-1] |= solo
        cut[1:] |= solo
        cut[edges] = True
        cut[-1] = False
        starts = np.flatnonzero(cut)
        sizes = np.diff(starts, append=len(flat))
        keys = mixed(RangeHash(flat).of(starts, starts + sizes))
        values, at, segment = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > KNOWN_SEGMENTS:
            self.forget()
        new = ~np.isin(values, self.keys, assume_unique=True)
        if new.any():
            self.learn(values[new], flat, starts[at[new]], sizes[at[new]])
        place = np.searchsorted(self.keys, values)
        begin, count = self.begin[place], self.count[place]
        lengths = count[segment]
        stops = np.cumsum(lengths)
        ids = self.ids[np.repeat(begin[segment] - (stops - lengths), lengths) + np.arange(stops[-1])]
        total = np.concatenate(([0], stops))
        return ids, np.diff(total[np.searchsorted(starts, edges)]), flat, edges


def decode(pieces: Pieces, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each with the space that marks its start, and their offsets."""
    sizes = pieces.sizes[ids]
    stops = np.cumsum(sizes)
    total = np.concatenate(([0], stops))
    flat = pieces.flat[np.repeat(pieces.begin[ids] - (stops - sizes), sizes) + np.arange(total[-1])]
    return flat, total[np.concatenate(([0], np.cumsum(counts)))]


def encoder(path: str):
    """Task: ids of every text, and whether they decode to the same text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = Segments(Pieces(path))
        spelled = np.zeros(len(segments.pieces.raw), bool)
        spelled[segments.pieces.byte_ids] = True
        for batch in chunks(batches, "text"):
            ids, counts, flat, edges = segments.encode(batch.column("text"))
            back, ends = decode(segments.pieces, ids, counts)
            same = np.zeros(len(counts), bool)
            if np.array_equal(ends, edges):
                wrong = np.concatenate(([0], np.cumsum(back != flat)))
                same = wrong[edges[1:]] == wrong[edges[:-1]]
            else:
                for i in range(len(counts)):
                    same[i] = np.array_equal(back[ends[i]:ends[i + 1]], flat[edges[i]:edges[i + 1]])
            stops = np.concatenate(([0], np.cumsum(counts)))
            raw = ids.astype("<u4")
            sums = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
            fallback = np.concatenate(([0], np.cumsum(spelled[ids])))
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(ids, pa.int32())),
                pa.array(counts, pa.int64()), pa.array(np.diff(fallback[stops]), pa.int64()),
                pa.array(sums, pa.int64()), pa.array(same)],
                names=["row", "ids", "n_pieces", "n_bytes_spelled", "ids_crc32", "round_trip"])

    return run


def encode_pieces(docs: DataFrame, model_path: str, keep: list[str] | None = None) -> DataFrame:
    """Encode every whole ``text`` with the pieces of a SentencePiece model, and decode it again.

    Result: the struct ``row`` with the columns ``keep`` (default ``doc_id``), so nothing can clash, beside
    ``ids``, ``n_pieces``, ``n_bytes_spelled`` (ids of single bytes, for signs that no piece has), ``ids_crc32``
    (of the ids as little-endian unsigned 32-bit integers) and ``round_trip`` (decoding gave the same text).

    The ids are the segmentation with the highest total of piece scores (ties: the longer last piece, from
    the end backwards), with a space marked before the text as the model does. White space is kept as it is.
    A null or empty text has no ids and round-trips as empty; repeated rows are encoded each. No shuffle.
    """
    rows = docs.select(as_row(keep or ["doc_id"]), "text")
    kind = row_type(rows)
    return rows.mapInArrow(encoder(model_path), (
        f"row {kind}, ids array<int>, n_pieces bigint, n_bytes_spelled bigint, ids_crc32 bigint, round_trip boolean"))


def decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            column = batch.column("ids").fill_null([])
            flat, ends = decode(pieces, column.flatten().to_numpy(), np.diff(column.offsets.to_numpy()))
            texts = [flat[a + 1:b].tobytes().decode() if b > a else "" for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts)], names=["row", "text"])

    return run


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """The texts of the rows that ``encode_pieces`` gave: ``row`` and ``text``; null ids give an empty text."""
    rows = encoded.select("row", "ids")
    kind = row_type(rows)
    return rows.mapInArrow(decoder(model_path), f"row {kind}, text string")
