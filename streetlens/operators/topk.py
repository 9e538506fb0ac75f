"""Sorted results with a limit; the key always breaks ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetlens.operators import filters


def top_rated(businesses: DataFrame, category: str | None = None, k: int = 20, literal: bool = False) -> DataFrame:
    """Best rating, then most reviews."""
    kept = filters.by_category(businesses, category, literal) if category else businesses
    return kept.orderBy(F.col("rating").desc(), F.col("review_count").desc(), "source_id").limit(k)


def top_by_category(businesses: DataFrame, category: str, k: int = 50, literal: bool = False) -> DataFrame:
    return filters.by_category(businesses, category, literal).orderBy(F.col("rating").desc(), "source_id").limit(k)


def top_filtered(businesses: DataFrame, k: int | None = None, **kwargs) -> DataFrame:
    """The combined business filter, best rating first."""
    kept = filters.filter_businesses(businesses, **kwargs)
    return kept if k is None else kept.orderBy(F.col("rating").desc(), "source_id").limit(k)


def top_growth_potential(businesses: DataFrame, k: int = 10) -> DataFrame:
    """Rated 4.0 or better with fewer reviews than the exact median.

    The median is taken from the counts per distinct ``review_count``, not from the rows.
    """
    counts = businesses.groupBy("review_count").agg(F.count(F.lit(1)).alias("n"))
    median = counts.agg(F.percentile("review_count", F.lit(0.5), F.col("n")))
    return (
        businesses.filter((F.col("rating") >= 4.0) & (F.col("review_count") < median.scalar()))
        .orderBy(F.col("rating").desc(), F.col("review_count").asc(), "source_id")
        .limit(k)
    )


def top_competitors(competitors: DataFrame, k: int = 10) -> DataFrame:
    """First ``k`` competitors of every business; needs the ``competitors`` array of joins.competitors."""
    return competitors.withColumn("competitors", F.slice("competitors", 1, k))


def top_keywords(counts: DataFrame, k: int = 20) -> DataFrame:
    return counts.orderBy(F.col("count").desc(), "keyword").limit(k)


def limit_records(df: DataFrame, n: int | None, order: Sequence[Column | str]) -> DataFrame:
    """At most ``n`` rows in a stated order; None keeps all."""
    return df if n is None else df.orderBy(*order).limit(n)
