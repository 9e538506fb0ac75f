"""Deletes and retention: every function returns what remains."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetlens.operators import joins
from streetlens.operators.filters import matches
from streetlens.session import stage_table


def _keep(df: DataFrame, condemned: Column) -> DataFrame:
    """Rows for which the condition is not true; null counts as not true."""
    return df.filter(~F.coalesce(condemned, F.lit(False)))


def delete_by_source(df: DataFrame, source: str) -> DataFrame:
    return df.filter(~F.col("source").eqNullSafe(F.lit(source)))


def delete_businesses_by_city(businesses: DataFrame, city: str, address_too: bool = True, literal: bool = False) -> DataFrame:
    return _keep(businesses, _in_city(city, address_too, literal))


def _in_city(city: str, address_too: bool, literal: bool) -> Column:
    hit = F.coalesce(matches(F.col("city"), city, literal), F.lit(False))
    return hit | F.coalesce(matches(F.col("address"), city, literal), F.lit(False)) if address_too else hit


def delete_reviews_by_city(
    businesses: DataFrame, reviews: DataFrame, city: str, address_too: bool = True, literal: bool = False,
) -> DataFrame:
    """Reviews that remain after deleting a city.

    ``address_too`` (the fuller variant) also deletes by the review's own city, provided that at
    least one business is deleted; otherwise reviews go by the name of a deleted business only.
    """
    gone = businesses.filter(_in_city(city, address_too, literal)).select("name")
    kept = joins.by_names(reviews, gone, anti=True)
    if address_too:
        any_gone = gone.agg(F.count(F.lit(1)) > 0).scalar()
        kept = _keep(kept, matches(F.col("business_city"), city, literal) & any_gone)
    return kept


def truncate(df: DataFrame) -> DataFrame:
    """Empty table of the same schema."""
    return df.sparkSession.createDataFrame([], df.schema)


#: Different sources that are sent to every task up to so many and so many bytes of them; beyond it, shares of a source.
SENT_SOURCES, SENT_BYTES, SOURCE_SHARES = 250_000, 8 << 20, 64


def delete_all_sources(df: DataFrame, businesses: DataFrame) -> DataFrame:
    """Delete the rows of every source that occurs among the businesses; a null source survives.

    A few sources are sent to the rows. Very many are dealt by source, each source of the rows to ``SOURCE_SHARES`` tasks
    in turn, so that no task reads all rows of one.
    """
    sources = stage_table(businesses.select("source").filter(F.col("source").isNotNull()).distinct(), "sources")
    size = sources.limit(SENT_SOURCES + 1).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.col("source").cast("string"))), F.lit(0)).alias("bytes")).first()
    if size.n <= SENT_SOURCES and size.bytes <= SENT_BYTES:
        return df.join(F.broadcast(sources), "source", "left_anti")
    shares = sources.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(SOURCE_SHARES - 1))))
    dealt = df.withColumn("__share", F.pmod(F.monotonically_increasing_id(), F.lit(SOURCE_SHARES)).cast("int"))
    return dealt.join(shares, ["source", "__share"], "left_anti").drop("__share")


def retention_cleanup(df: DataFrame, as_of: dt.datetime, days: int = 90, column: str = "generated_at") -> DataFrame:
    """Delete rows strictly older than ``days``; undated rows stay."""
    return _keep(df, F.col(column) < F.lit(as_of - dt.timedelta(days=days)))
