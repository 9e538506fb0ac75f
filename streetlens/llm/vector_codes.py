"""Product codes of vectors: codebooks fitted on distinct parts, distances shared along a trie of the parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streetlens.llm.vectors import integer_vectors, integers
from streetlens.session import stage_table

#: Scaled components stay below this, so that a distance over 2**13 components fits in 62 bits.
LARGEST = 1 << 23
#: Rows of a subtree that are walked together, level by level; with 256 entries 1 or 2 MB of distances.
SUBTREE = 1024


class Trie:
    """Distinct rows in lexicographic order, seen as a trie: a node of level l is a run of rows equal up to l.

    ``starts[l]`` are the first rows of the nodes whose rows share l + 1 dimensions.
    """

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        changed = np.ones((len(rows), rows.shape[1]), bool)
        if len(rows) > 1:
            np.logical_or.accumulate(rows[1:] != rows[:-1], axis=1, out=changed[1:])
        self.starts = [np.flatnonzero(changed[:, level]) for level in range(rows.shape[1])]

    def children(self, level: int, low: int, high: int) -> np.ndarray:
        """First rows of the nodes of a level among the rows from ``low`` to ``high``, and ``high``."""
        starts = self.starts[level]
        return np.append(starts[np.searchsorted(starts, low):np.searchsorted(starts, high)], high)


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lowest of equally near ones) and squared distance of each row.

    ``rows`` are distinct and sorted. The trie is walked depth first: a node's distances to all entries over the
    dimensions so far are its parent's plus one column, computed once for all rows below it. A subtree of at most
    ``SUBTREE`` rows is walked level by level in one array; a larger one child by child, so that memory holds one
    vector of distances for each level and one block.
    """
    width = rows.shape[1]
    chosen, error = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    if not len(rows):
        return chosen, error
    trie = Trie(rows)
    widest = int(rows.max()) - int(min(rows.min(), entries.min()))
    widest = max(widest, int(entries.max()) - int(rows.min()), 1)
    kind = np.int32 if widest * widest * width < 1 << 31 else np.int64
    columns = np.ascontiguousarray(entries.T)

    def added(level: int, values: np.ndarray) -> np.ndarray:
        """Squared differences of the values to the entries in one dimension, one row for each value."""
        different, which = np.unique(values, return_inverse=True)
        gap = (different[:, None] - columns[level]).astype(kind)
        return (gap * gap)[which]

    stack = [(0, 0, len(rows), np.zeros((1, len(entries)), kind))]
    while stack:
        level, low, high, distance = stack.pop()
        if high - low > SUBTREE and level < width:
            at = trie.children(level, low, high)
            if len(at) == 2:
                stack.append((level + 1, low, high, distance + added(level, rows[low:low + 1, level])))
                continue
            # neighbouring small children share a block, a large child is a subtree of its own
            start = 0
            while start < len(at) - 1:
                stop = max(start + 1, int(np.searchsorted(at, at[start] + SUBTREE, "right")) - 1)
                if at[stop] - at[start] > SUBTREE:
                    stack.append((level + 1, at[start], at[stop], distance + added(level, rows[at[start]:at[start] + 1, level])))
                else:
                    stack.append((level, at[start], at[stop], distance))
                start = stop
            continue
        parents = np.array([low])
        for deeper in range(level, width):
            nodes = trie.children(deeper, low, high)[:-1]
            if len(nodes) > len(parents):
                distance = distance[np.searchsorted(parents, nodes, "right") - 1]
            distance = distance + added(deeper, rows[nodes, deeper])
            parents = nodes
        best = distance.argmin(axis=1)
        chosen[low:high], error[low:high] = best, distance[np.arange(len(best)), best]
    return chosen, error


def distinct_parts(kept: DataFrame, parts: int, width: int) -> DataFrame:
    """``position``, ``part``, ``weight``: the different parts of each position and how often they occur, in order.

    Equal parts are counted before they are exchanged, so a vector that a third of all rows repeat is one row for each
    task; ordered by range, neighbouring rows of a task share their first dimensions.
    """
    # only the last parts may be short, where the length is no multiple of their number
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), parts * width))
    cut = F.array(*[F.struct(F.lit(p).alias("position"), F.slice(padded, p * width + 1, width).alias("part")) for p in range(parts)])
    pieces = kept.select(F.inline(cut))
    counted = pieces.groupBy("position", "part").agg(F.count(F.lit(1)).alias("weight"))
    return stage_table(counted.repartitionByRange("position", "part").sortWithinPartitions("position", "part"), "vector-parts")


def part_runs(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The rows of a batch by position, sorted: position, parts, weights."""
    positions = np.asarray(batch.column(0))
    rows, weights = integers(batch.column(1), width), np.asarray(batch.column(2))
    for position in np.unique(positions):
        mine = np.flatnonzero(positions == position)
        mine = mine[np.lexsort(rows[mine].T[::-1])]
        yield int(position), rows[mine], weights[mine]


def next_codebooks(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every part to its nearest entry, every entry to the floor of the mean of its parts.

    Each task adds up counts and weighted sums of all entries; only those are exchanged and collected, parts * entries
    rows whatever the input. An entry without parts stays.
    """
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for position, rows, weights in part_runs(batch, width):
                chosen, _ = nearest(rows, books[position])
                np.add.at(counts[position], chosen, weights)
                np.add.at(sums[position], chosen, rows * weights[:, None])
        used = np.flatnonzero(counts.ravel())
        values = np.column_stack((counts.reshape(-1, 1), sums.reshape(-1, width)))[used]
        yield pa.RecordBatch.from_pydict({
            "entry": np.repeat(used, width + 1).astype(np.int32), "place": np.tile(np.arange(width + 1, dtype=np.int32), len(used)),
            "value": values.ravel()})

    added = distinct.mapInArrow(run, "entry int, place int, value bigint").groupBy("entry", "place")
    totals = np.zeros((parts * entries, width + 1), np.int64)
    for row in added.agg(F.sum("value").alias("value")).collect():
        totals[row.entry, row.place] = row.value
    used = totals[:, 0] > 0
    out = books.reshape(-1, width).copy()
    out[used] = totals[used, 1:] // totals[used, :1]
    return out.reshape(books.shape)


def fit_codebooks(kept: DataFrame, length: int, id_column: str, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (parts, entries, width) of the kept vectors: started from those of the smallest ids."""
    width = -(-length // parts)
    first = kept.orderBy(F.col("row")[id_column].asc_nulls_last(), "x").limit(entries).select("x").collect()
    start = np.zeros((len(first), parts * width), np.int64)
    start[:, :length] = [r.x for r in first]
    books = start.reshape(len(first), parts, width).transpose(1, 0, 2)
    distinct = distinct_parts(kept, parts, width)
    for _ in range(rounds):
        books = next_codebooks(distinct, books)
    return books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' integers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress_vectors(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_column: str = "vec_id",
    vector_column: str = "embedding", scale: int = 1024, carry: Sequence[str] = (),
) -> DataFrame:
    """Every usable vector as one byte for each part: the nearest entry of the part's codebook.

    Result: ``row`` (struct of the id and the ``carry`` columns), ``code`` (two hex digits a part), ``error`` (squared
    distances summed), ``codebooks_sha256``. Components are ``floor(scale * c)``; all arithmetic is on integers, so the
    result does not depend on the order of tasks.

    Left out: null and empty vectors, those with a null or non-finite component or one of 2**23 or more after scaling,
    and those of another than the most common length. A length that is no multiple of ``parts`` is filled up with
    zeros. With fewer vectors than ``entries`` the codebooks are that short. Codebooks start from the smallest ids,
    nulls last, of equal ids the smaller vectors. Repeated rows count each time and appear each time; an empty table
    gives none. Other columns are ignored.

    Vectors are exchanged once, as distinct parts with counts; each round reads those. The last assignment runs over
    the vectors themselves, without an exchange.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte: from 1 to 256 entries")
    names = [id_column, *[c for c in carry if c != id_column]]
    kept, length = integer_vectors(vectors, vector_column, scale, names, LARGEST)
    schema = T.StructType([kept.schema["row"], *T.StructType.fromDDL("code string, error bigint, codebooks_sha256 string").fields])
    if not length:
        return vectors.sparkSession.createDataFrame([], schema)
    books = fit_codebooks(kept, length, id_column, parts, entries, rounds)
    width, digest = books.shape[2], codebooks_digest(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, parts * width), np.int64)
            x[:, :length] = integers(batch.column(1), length)
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                rows, which = np.unique(x[:, p * width:(p + 1) * width], axis=0, return_inverse=True)
                chosen, distance = nearest(rows, books[p])
                codes[:, p] = chosen[which]
                error += distance[which]
            yield pa.RecordBatch.from_pydict({
                "row": batch.column(0), "code": [c.tobytes().hex() for c in codes], "error": error,
                "codebooks_sha256": [digest] * len(x)})

    return kept.mapInArrow(run, schema)


def with_label_errors(coded: DataFrame, label_column: str = "label") -> DataFrame:
    """Coded vectors with ``label_error``: the error of all vectors of the same label, nulls together.

    Errors are added up before they are exchanged; a label that a third of the vectors carry is one row of the sums.
    The sum is null where a long cannot hold it.
    """
    label = F.col("row")[label_column]
    coded = stage_table(coded, "vector-codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy(label.alias("label")).agg(total.alias("total"))
    sums = sums.select("label", F.when(F.col("total") <= F.lit((1 << 63) - 1), F.col("total")).cast("bigint").alias("label_error"))
    return coded.join(sums, label.eqNullSafe(sums["label"])).drop("label")
