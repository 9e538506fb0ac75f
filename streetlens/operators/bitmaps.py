"""Bit maps of 64-bit hashes that tell tasks which rows may matter."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest bit map; beyond it more rows travel in vain, the result is the same.
LARGEST_BITS = 1 << 28


def bit_map(hashes: DataFrame, count: int, largest: int = LARGEST_BITS):
    """Broadcast bit map of the column ``h``, 16 bits for each of ``count`` up to ``largest``; bits are set by bucket in the tasks."""
    bits = min(largest, 1 << max(15, (16 * count - 1).bit_length()))
    at = F.col("h").bitwiseAND(bits - 1)
    parts = hashes.select(F.shiftright(at, 15).alias("bucket"), at.bitwiseAND((1 << 15) - 1).alias("bit"))
    total = np.zeros(bits // 8, np.uint8)
    for row in parts.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        total[row.bucket * 4096:(row.bucket + 1) * 4096] = np.frombuffer(row.bits, np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(total)
