"""A bounded sample of labelled rows for the driver, the same in every run."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(
    labelled: DataFrame, rows: int, key: str = "doc_id", shape: Callable[[DataFrame], DataFrame] | None = None,
) -> pa.Table:
    """At most ``rows`` rows, those with the smallest hashed keys, sorted by them.

    The hash is compared with the share that is needed before anything is sorted, so that what the tasks
    send does not grow with their number. ``shape`` changes the other columns of the rows that pass, inside the tasks.
    """
    total = labelled.count()
    order = F.pmod(F.xxhash64(F.lit("sample"), F.col(key).cast("string")), F.lit(1 << 40))
    some = labelled.withColumn("sample_order", order).filter(F.col("sample_order") < int((1 << 40) * min(1.0, 1.25 * rows / max(1, total))))
    if shape:
        some = shape(some)
    return some.orderBy("sample_order", *labelled.columns).limit(rows).drop("sample_order").toArrow()
