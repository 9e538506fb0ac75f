"""Connected components of links, and bounded filters for joins with few partners."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetlens.llm.arrays import mixed
from streetlens.session import stage_table

#: Bits of a filter for each value, and at most; bytes of the slices it is merged in.
BITS_A_VALUE, MOST_BITS, SLICE_BYTES = 16, 1 << 29, 1 << 17


def connected_components(links: DataFrame) -> DataFrame:
    """``id``, ``label`` (smallest id that can be reached) of all ends of ``links`` (``a``, ``b``).

    Each round every node joins its smallest neighbour, and the links between what became one node vanish.
    Rounds end when no link is left; a star or a clique needs one, a path of n about log n. Rounds are cut at
    written tables. Links to oneself and repeated links do no harm; a null end drops its link.
    """
    open_ = stage_table(links.filter("a is not null and b is not null").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes = stage_table(open_.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("label", F.col("id")), "nodes")
    open_ = open_.filter("a <> b")
    while not open_.isEmpty():
        ways = open_.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("w")).select("w.*")
        parent = stage_table(ways.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("parent")), "parents")
        nodes = stage_table(nodes.join(parent, nodes["label"] == parent["node"], "left").select("id", F.coalesce("parent", "label").alias("label")), "nodes")
        half = open_.join(parent, open_["a"] == parent["node"]).select(F.col("parent").alias("a"), "b")
        # parents of both ends; each join may split a node with very many links
        moved = half.join(parent, half["b"] == parent["node"]).select("a", F.col("parent").alias("b"))
        open_ = stage_table(moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return nodes


def bits_of(values: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(values.view(np.uint64) + np.uint64(11)) & np.uint64(bits - 1)).astype(np.int64)


def marker(bits: int):
    """Task: the slices of the bit map that its values mark, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = bits_of(batch.column(0).to_numpy(), bits)
            np.bitwise_or.at(total, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        for number, part in enumerate(total.reshape(-1, SLICE_BYTES)):
            if part.any():
                yield slice_row(number, part)

    return run


def slice_row(number: int, part: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"slice": pa.array([number], pa.int32()), "marks": [zlib.compress(part.tobytes(), 1)]})


def slice_merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: one row for each of its slices, with the marks of all tasks; slices come one after another."""
    number, total = -1, np.zeros(SLICE_BYTES, np.uint8)
    for batch in batches:
        for at, marks in zip(batch.column("slice").to_pylist(), batch.column("marks").to_pylist(), strict=True):
            if at != number and number >= 0:
                yield slice_row(number, total)
                total = np.zeros(SLICE_BYTES, np.uint8)
            number = at
            total |= np.frombuffer(zlib.decompress(marks), np.uint8)
    if number >= 0:
        yield slice_row(number, total)


def value_filter(values: DataFrame):
    """Broadcast bit map of a column of 64-bit values, for dropping what surely is not among them.

    It has ``BITS_A_VALUE`` bits for each value counted, ``MOST_BITS`` (64 MB) at most: one in sixteen
    others passes. Beyond 30 million values it fills up, and with very many it lets everything through. It only
    saves shuffling: whoever uses it joins with the values afterwards. Tasks mark slices of the map, which are
    merged by slice; the driver gets the merged map alone.
    """
    spark = values.sparkSession
    known = values.filter(F.col(values.columns[0]).isNotNull())
    bits = filter_bits(known.count())
    slices = known.mapInArrow(marker(bits), "slice int, marks binary").repartition(F.col("slice")).sortWithinPartitions("slice")
    total = np.zeros(bits // 8, np.uint8)
    for row in slices.mapInArrow(slice_merger, "slice int, marks binary").collect():
        total[row.slice * SLICE_BYTES:(row.slice + 1) * SLICE_BYTES] = np.frombuffer(zlib.decompress(row.marks), np.uint8)
    return spark.sparkContext.broadcast(total)


def filter_bits(count: int) -> int:
    """A power of two."""
    return min(MOST_BITS, max(8 * SLICE_BYTES, 1 << (BITS_A_VALUE * count - 1).bit_length() if count else 0))


def maybe(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values may be among those of the filter."""
    at = bits_of(values, 8 * len(bits))
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
