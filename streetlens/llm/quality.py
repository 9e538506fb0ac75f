"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetlens.llm.arrays import RangeHash, chunks, mixed, text_bytes
from streetlens.llm.columns import as_row, row_type
from streetlens.llm.sampling import bounded_sample

#: Words are hashed into so many buckets; the vectors of all of them together are small at any input size.
BUCKETS, DIMENSIONS, NEIGHBOURS = 1 << 14, 32, 2

#: Rows that the vectors are sent in, partial sums of one row, labelled rows the network is fitted on at most.
BLOCK, SALTS, TRAIN_ROWS = 2048, 16, 6000


def kinds() -> np.ndarray:
    """Kind of each byte: 0 white space, 1 small letter or beyond ASCII, 2 capital, 3 digit, 4 other sign."""
    table = np.full(256, 4, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 0
    table[97:123] = table[128:] = 1
    table[65:91] = 2
    table[48:58] = 3
    return table


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each run of bytes of one kind, and the number of the first run of each text."""
    data, offsets = text_bytes(column)
    kind = kinds()[data]
    opens = np.zeros(len(data) + 1, bool)
    opens[1:-1] = kind[1:] != kind[:-1]
    opens[offsets[(offsets < len(data))]] = True
    opens[-1] = True
    edges = np.flatnonzero(opens)
    starts, ends = edges[:-1], edges[1:]
    full = kind[starts] > 0
    starts, ends = starts[full], ends[full]
    bucket = (RangeHash(data).of(starts, ends) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return bucket, np.searchsorted(starts, offsets)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The sparse random vector of each bucket: two places and their signs."""
    h = mixed(np.arange(BUCKETS, dtype=np.uint64) + np.uint64(77))
    place = np.stack([(h & np.uint64(DIMENSIONS - 1)), (h >> np.uint64(8)) & np.uint64(DIMENSIONS - 1)], axis=1).astype(np.int64)
    sign = np.stack([(h >> np.uint64(20)) & np.uint64(1), (h >> np.uint64(21)) & np.uint64(1)], axis=1).astype(np.int64) * 2 - 1
    return place, sign


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: sums of the index vectors of the neighbours of each bucket, over all its texts."""
    place, sign = index_vectors()
    total = np.zeros(BUCKETS * DIMENSIONS)
    seen = False
    for batch in chunks(batches, "text"):
        bucket, first = tokens(batch.column("text"))
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for apart in range(1, NEIGHBOURS + 1):
            same = np.flatnonzero(text[apart:] == text[:-apart])
            left, right = bucket[same], bucket[same + apart]
            seen = seen or bool(len(left))
            for word, near in ((left, right), (right, left)):
                for i in (0, 1):
                    total += np.bincount(word * DIMENSIONS + place[near, i], sign[near, i], BUCKETS * DIMENSIONS)
    if seen:
        parts = total.astype(np.int64).reshape(-1, BLOCK * DIMENSIONS)
        salt = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(range(len(parts)), pa.int32()), "salt": pa.array([salt] * len(parts), pa.int32()),
            "sums": [p.tobytes() for p in parts]})


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            total[block] = total.get(block, 0) + np.frombuffer(sums, np.int64)
    if total:
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(list(total), pa.int32()), "salt": pa.array([0] * len(total), pa.int32()),
            "sums": [t.tobytes() for t in total.values()]})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets from the neighbourhoods in all texts (2 MB, whatever the input).

    Partial sums of the tasks are added up in two steps, so that no task gets a row from every other.
    """
    kind = "block int, salt int, sums binary"
    part = docs.select("text").mapInArrow(contexts, kind)
    blocks = BUCKETS // BLOCK
    part = part.repartition(4 * blocks, "block", "salt").mapInArrow(summed, kind)
    part = part.repartition(blocks, "block").mapInArrow(summed, kind)
    vectors = np.zeros((blocks, BLOCK * DIMENSIONS))
    for row in part.collect():
        vectors[row.block] += np.frombuffer(row.sums, np.int64)
    vectors = vectors.reshape(BUCKETS, DIMENSIONS)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text, and their mean distance to the next and the one after.

    The distances tell flowing text from one that repeats itself. Zeros where there is no word.
    """
    bucket, first = tokens(column)
    n = len(first) - 1
    end = np.repeat(first[1:], np.diff(first))
    sums = np.zeros((n, 2 * DIMENSIONS + 2))
    for start in range(0, len(bucket), 1 << 15):
        stop = min(start + (1 << 15), len(bucket))
        rows = vectors[bucket[start:stop]]
        parts = [rows, rows * rows]
        for apart in (1, 2):
            at = np.arange(start, stop) + apart
            near = vectors[bucket[np.minimum(at, len(bucket) - 1)]]
            parts.append(np.where(at < end[start:stop], np.einsum("nd,nd->n", rows - near, rows - near), 0)[:, None])
        low, high = np.searchsorted(first, start, "right") - 1, np.searchsorted(first, stop, "left")
        edges = np.maximum(first[low:high], start) - start
        full = np.diff(np.append(edges, stop - start)) > 0
        sums[np.arange(low, high)[full]] += np.add.reduceat(np.concatenate(parts, axis=1), edges[full], axis=0)
    out = sums / np.maximum(np.diff(first), 1)[:, None]
    spread = out[:, DIMENSIONS:2 * DIMENSIONS]
    spread[:] = np.sqrt(np.maximum(spread - out[:, :DIMENSIONS] ** 2, 0))
    return out


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 64, seed: int = 5) -> dict[str, np.ndarray]:
    """Two layers by Adam on four fifths of the rows; the temperature is set on the others."""
    random = np.random.default_rng(seed)
    order = random.permutation(len(x))
    held, used = order[:len(x) // 5], order[len(x) // 5:]
    centre, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
    net = {
        "w1": random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), "b1": np.zeros(hidden),
        "w2": random.normal(0, 1 / np.sqrt(hidden), (hidden, 1)), "b2": np.zeros(1)}
    mean, square = {k: np.zeros_like(v) for k, v in net.items()}, {k: np.zeros_like(v) for k, v in net.items()}
    t, total = 0, epochs * -(-len(used) // batch)
    for _ in range(epochs):
        for start in range(0, len(used), batch):
            t += 1
            some = random.permutation(used)[:batch]
            a = (x[some] - centre) / scale
            h = np.maximum(a @ net["w1"] + net["b1"], 0)
            p = 1 / (1 + np.exp(-(h @ net["w2"] + net["b2"])))
            d = (p - y[some, None]) / len(some)
            back = (d @ net["w2"].T) * (h > 0)
            grads = {"w2": h.T @ d, "b2": d.sum(axis=0), "w1": a.T @ back + 1e-4 * net["w1"], "b1": back.sum(axis=0)}
            rate = 0.01 * (1 - t / (total + 1))
            for k, g in grads.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                net[k] -= rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-8)
    net |= {"centre": centre, "scale": scale, "temperature": np.ones(1)}
    if len(held):
        logit, truth = logits(net, x[held]), y[held]
        heats = np.geomspace(0.25, 8, 41)
        loss = [np.mean(np.logaddexp(0, logit / heat) - truth * logit / heat) for heat in heats]
        net["temperature"] = heats[[int(np.argmin(loss))]]
    return net


def logits(net: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    h = np.maximum((x - net["centre"]) / net["scale"] @ net["w1"] + net["b1"], 0)
    return (h @ net["w2"] + net["b2"])[:, 0] / net["temperature"]


def pooler(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(list(pooled(batch.column("text"), sent.value)), pa.list_(pa.float64()))],
                names=["label", "x"])

    return run


def scorer(sent, net: dict[str, np.ndarray] | None, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            score = np.full(batch.num_rows, 0.5)
            if net:
                score = 1 / (1 + np.exp(-np.clip(logits(net, pooled(batch.column("text"), sent.value)), -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(score), pa.array((score >= limit).astype(np.int32))],
                names=["row", "score", "predicted"])

    return run


def score_quality(
    docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, limit: float = 0.3, rows: int = TRAIN_ROWS,
) -> DataFrame:
    """Quality of every whole text: the struct ``row`` with the columns ``keep`` beside ``score`` and ``predicted``.

    ``labels`` has ``doc_id`` and ``quality`` (1 good, 0 bad; null teaches nothing). Word vectors come from the
    neighbourhoods in all texts of ``docs``; the network over their mean and spread is fitted on a bounded sample of
    labelled texts (``rows``). ``score`` is the calibrated probability of label 1, ``predicted`` is 1 from ``limit``
    on. A null or empty text has pooled zeros and is scored like any other; without any labelled text every
    score is 0.5. Labels without a document do no harm, and repeated rows teach once. Only labelled texts of the
    sample are shuffled.
    """
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs))
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label"))
    sample = spark.createDataFrame(bounded_sample(usable, rows).to_pandas(), usable.schema)
    # the sample has at most ``rows`` rows of two numbers
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", "doc_id", "text").distinct()
    points = chosen.select("label", "text").mapInArrow(pooler(vectors), "label int, x array<double>")
    # the bound takes both labels alike
    found = points.orderBy(F.xxhash64("x"), "label", "x").limit(4 * rows).orderBy("label", "x").toArrow()
    net = None
    if found.num_rows:
        net = fit(np.array(found.column("x").to_pylist()), np.array(found.column("label").to_pylist(), float))
    every = docs.select(as_row(keep or ["doc_id"]), "text")
    kind = row_type(every)
    return every.mapInArrow(scorer(vectors, net, limit), f"row {kind}, score double, predicted int")


def good_documents(docs: DataFrame, labels: DataFrame, limit: float = 0.3) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    return score_quality(docs, labels, docs.columns, limit).filter("predicted = 1").select("row.*")
