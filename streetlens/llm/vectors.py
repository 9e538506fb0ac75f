"""Vectors as exact integers: what the operators on embeddings share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled components from here on cannot be summed up exactly; their vectors count as unusable.
LARGEST = 1 << 48


def named(column: str) -> Column:
    """A top-level column by its name, whatever signs the name holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def row_of(df: DataFrame, carry: Sequence[str]) -> Column:
    """The carried columns as one struct, so that none can clash with a result."""
    return F.struct(*[named(c) for c in carry if c in df.columns])


def integer_vectors(
    vectors: DataFrame, vector_column: str, scale: int, carry: Sequence[str], largest: int = LARGEST,
) -> tuple[DataFrame, int]:
    """``row`` (struct of ``carry``), ``x``: each component c as ``floor(scale * c)``; and the vectors' length.

    Left out: null and empty vectors, vectors with a null or non-finite component or one of ``largest`` or more
    after scaling, and vectors whose length is not the most common one (the longer of two equally common).
    """
    v = named(vector_column)
    scaled = F.transform(v, lambda c: F.lit(float(scale)) * c.cast("double"))
    rows = vectors.select(row_of(vectors, carry).alias("row"), scaled.alias("scaled"))
    sound = rows.filter(F.size("scaled") > 0).filter(F.forall("scaled", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(largest))))
    lengths = sound.groupBy(F.size("scaled").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    length = common[0].length if common else 0
    kept = sound.filter(F.size("scaled") == length)
    return kept.select("row", F.transform("scaled", lambda c: F.floor(c).cast("bigint")).alias("x")), length


def integers(column: pa.Array, length: int) -> np.ndarray:
    """A list column of one length without nulls as a matrix."""
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, length)


def exact_sums(frame: DataFrame, task) -> dict[int, int]:
    """Sums over all tasks of the integers that ``task`` adds up: it gives (place, integer) for each batch's matrix.

    ``task(batch)`` returns an array of Python integers; arrays of all batches of a task are added and one row for each
    place leaves it, so the driver receives one number for each place, whatever the input.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = task(batch)
                total = part if total is None else total + part
        if total is not None:
            values = pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), values], ["place", "value"])

    parts = frame.mapInArrow(run, "place int, value decimal(38,0)")
    return {r.place: int(r.value) for r in parts.groupBy("place").agg(F.sum("value").alias("value")).collect()}
