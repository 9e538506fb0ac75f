"""Readers of stored collections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_collection(spark: SparkSession, path: str, schema: StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet collection with a fixed schema; ``columns`` prunes the scan."""
    df = spark.read.schema(schema).parquet(path)
    return df if columns is None else df.select(*columns)

