"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_values(df: DataFrame, column: str, drop_null: bool = True, drop_empty: bool = False) -> DataFrame:
    values = df.select(column)
    if drop_null:
        values = values.filter(F.col(column).isNotNull())
    if drop_empty:
        values = values.filter(F.coalesce(F.col(column) != "", F.lit(True)))
    return values.distinct()


def union_with_competitors(businesses: DataFrame, competitors: DataFrame) -> DataFrame:
    """Every business and its competitors as rows with a ``type`` column."""
    own = businesses.select(
        F.col("source_id").alias("business_id"), "source_id", "name", "rating", "review_count",
        F.lit("Your Business").alias("type"),
    )
    others = competitors.select("business_id", F.explode("competitors").alias("c")).select(
        "business_id", "c.source_id", "c.name", "c.rating", "c.review_count", F.lit("Competitor").alias("type"),
    )
    return own.unionByName(others)


def concat_sources(
    frames: list[DataFrame], order: list[Column], per_frame: int | None = None, cap: int | None = None,
    distinct: bool = False, max_frames: int | None = None,
) -> DataFrame:
    """Search results one after another, duplicates kept; the first ``per_frame`` of each and ``cap`` of all
    when given."""
    parts = []
    for position, frame in enumerate(frames[:max_frames]):
        part = frame if per_frame is None else frame.orderBy(*order).limit(per_frame)
        parts.append(part.withColumn("search_no", F.lit(position)))
    merged = reduce(DataFrame.unionByName, parts)
    if distinct:
        merged = merged.drop("search_no").distinct()
        return merged if cap is None else merged.orderBy(*order).limit(cap)
    return merged if cap is None else merged.orderBy("search_no", *order).limit(cap)


def unique_keywords(column: Column) -> Column:
    return F.array_distinct(column)
