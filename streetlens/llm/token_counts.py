"""Token counts that follow edits: a segment tree over the pre-tokens of each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetlens.llm.arrays import chunks
from streetlens.llm.columns import as_row, row_type

#: Distinct pre-tokens whose counts a task remembers.
KNOWN = 400_000

#: Pre-tokens before an edit that are cut anew with it: a pre-token looks one sign beyond its end.
CONTEXT = 2


class Counter:
    """Number of tokens of a pre-token, by a byte-pair vocabulary given as ranks."""

    def __init__(self, ranks_path: str, pattern: str):
        import base64

        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def __call__(self, piece: str) -> int:
        count = self.known.get(piece)
        if count is None:
            if len(self.known) > KNOWN:
                self.known.clear()
            count = self.known[piece] = len(self.encode(piece))
        return count


class TokenTree:
    """Pre-tokens of one text in slots, with sums of their signs and tokens over a binary tree of slots.

    An edit cuts only the slots it touches anew, with ``CONTEXT`` slots before them, and goes on to the right
    until a cut meets an old one: what follows depends on nothing before it. New pre-tokens go into the slots
    that were cut (the last takes all that remain), and only the sums above those slots are added up again.
    """

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        pieces = counter.pattern.findall(text)
        self.slots: list[list[str]] = [[p] for p in pieces]
        self.size = 1 << max(0, (len(pieces) - 1).bit_length())
        self.sums = np.zeros((2, 2 * self.size), np.int64)
        n = len(pieces)
        self.sums[0, self.size:self.size + n] = list(map(len, pieces))
        self.sums[1, self.size:self.size + n] = list(map(counter, pieces))
        level = self.size
        while level > 1:
            self.sums[:, level // 2:level] = self.sums[:, level:2 * level:2] + self.sums[:, level + 1:2 * level:2]
            level //= 2
        if not self.slots:
            self.slots = [[]]
        self.recounted = 0

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def signs(self) -> int:
        return int(self.sums[0, 1])

    def slot_at(self, sign: int) -> tuple[int, int]:
        """Slot that holds the sign at this offset (the last one for the end of the text), and where it starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            left = int(self.sums[0, node])
            if sign >= start + left and node + 1 < 2 * self.size and self.sums[0, node + 1] > 0:
                start += left
                node += 1
        return min(node - self.size, len(self.slots) - 1), start

    def filled(self, slot: int, back: int) -> int:
        """The slot ``back`` filled slots before this one, or the first."""
        while back and slot:
            slot -= 1
            back -= bool(self.slots[slot])
        return slot

    def edit(self, start: int, removed: int, inserted: str) -> None:
        """Replace ``removed`` signs from ``start`` on; positions beyond the text are moved to its end."""
        start = min(max(start, 0), self.signs)
        stop = min(start + max(removed, 0), self.signs)
        first = self.filled(self.slot_at(start)[0], CONTEXT)
        last = self.slot_at(stop)[0]
        begin = self.before(first)
        old = [p for slot in self.slots[first:last + 1] for p in slot]
        text = "".join(old)
        text = text[:start - begin] + inserted + text[stop - begin:]
        done = start - begin + len(inserted)
        end = last + 1
        pieces: list[str] = []
        at = 0
        while True:
            # a cut is final only when the text behind it is known; meet an old cut behind the edit
            tail_start = len(text)
            more = [p for slot in self.slots[end:end + 8] for p in slot]
            end = min(end + 8, len(self.slots))
            text += "".join(more)
            cuts = set()
            place = tail_start
            for p in more:
                cuts.add(place)
                place += len(p)
            finished = end >= len(self.slots)
            met = False
            for match in self.counter.pattern.finditer(text, at):
                if match.start() in cuts and match.start() >= done:
                    met = True
                    break
                if match.end() == len(text) and not finished:
                    break
                pieces.append(match.group())
                at = match.end()
            if met or finished:
                break
        kept: list[str] = []
        if met:
            place = tail_start
            for p in more:
                if place >= at:
                    kept.append(p)
                place += len(p)
        self.recounted += len(pieces)
        new = pieces + kept
        room = max(1, end - first)
        for i in range(first, first + room):
            self.slots[i] = new[i - first:i - first + 1] if i < first + room - 1 else new[room - 1:]
        self.refresh(first, first + room)

    def before(self, slot: int) -> int:
        """Signs in the slots before this one, from the sums beside the path to it."""
        node, total = slot + self.size, 0
        while node > 1:
            if node % 2:
                total += int(self.sums[0, node - 1])
            node //= 2
        return total

    def refresh(self, first: int, stop: int) -> None:
        """Sums of these slots and of all nodes above them."""
        for i in range(first, stop):
            self.sums[0, self.size + i] = sum(map(len, self.slots[i]))
            self.sums[1, self.size + i] = sum(map(self.counter, self.slots[i]))
        low, high = first + self.size, stop - 1 + self.size
        while low > 1:
            low, high = low // 2, high // 2
            self.sums[:, low:high + 1] = self.sums[:, 2 * low:2 * high + 1:2] + self.sums[:, 2 * low + 1:2 * high + 2:2]

    def text(self) -> str:
        return "".join(p for slot in self.slots for p in slot)


def counting(ranks_path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks_path, pattern)
        for batch in chunks(batches, "text"):
            out = []
            for text, edits in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist(), strict=True):
                tree = TokenTree(text or "", counter)
                before, applied = tree.tokens, 0
                for e in edits or []:
                    if e and e["start"] is not None:
                        tree.edit(e["start"], e["removed"] or 0, e["inserted"] or "")
                        applied += 1
                out.append((before, tree.tokens, tree.signs, applied, tree.recounted))
            columns = np.array(out, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *map(pa.array, columns)],
                names=["row", "n_before", "n_tokens", "n_chars", "n_edits", "n_recounted"])

    return run


def edited_token_counts(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """Token counts of every whole ``text`` before and after its ``edits``, without encoding it again.

    ``edits`` is an array of structs ``start``, ``removed``, ``inserted`` (offsets in code points of the text as
    the edits before have left it), applied in order. Result: the struct ``row`` with the columns ``keep`` (default
    ``doc_id``) beside ``n_before``, ``n_tokens``, ``n_chars`` after all edits, ``n_edits`` and ``n_recounted``, the
    pre-tokens that were encoded anew. Counts equal those of encoding the edited text.

    A null text is empty; null edits, and edits with a null start, are left out; a null ``removed`` is 0, a null
    ``inserted`` empty; offsets beyond the text mean its end. Repeated rows are counted each. No shuffle.
    """
    rows = docs.select(as_row(keep or ["doc_id"]), "text", "edits")
    kind = row_type(rows)
    return rows.mapInArrow(counting(ranks_path, pattern), (
        f"row {kind}, n_before bigint, n_tokens bigint, n_chars bigint, n_edits bigint, n_recounted bigint"))
