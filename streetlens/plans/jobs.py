"""Composed jobs: plain functions over tables that return the new tables, and what they did."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetlens.functions import scalars
from streetlens.operators import aggregates, enrich, filters, joins, windows
from streetlens.session import scratch_path, stage_table
from streetlens.sinks import tables, upsert
from streetlens.sources import places


def _count(df: DataFrame, condition: Column | None = None) -> Column:
    value = F.count(F.lit(1)) if condition is None else F.count_if(condition)
    return df.agg(value).scalar()


def _summary(spark, **counts: Column) -> DataFrame:
    return spark.range(1).select(*[value.alias(name) for name, value in counts.items()])


def _like(table: DataFrame, new: DataFrame) -> DataFrame:
    """The columns of a stored table only; one without columns yet takes them all."""
    return new.select(*table.columns) if table.columns else new


def full_run(
    reviews: DataFrame, businesses: DataFrame, as_of: dt.datetime, lexicon: Mapping[str, float],
    stop_words: Sequence[str] | None = None, days: int = 7, out: str | None = None, max_terms: int | None = None,
) -> dict[str, DataFrame]:
    """Enrich what is new, then analytics and trending keywords over all reviews.

    Returns the new tables ``reviews`` (processed ones stay as they are), ``businesses`` (with ``analytics``, a
    struct, and ``analytics_updated``; both stay null without reviews) and ``trending_keywords``, as written, and
    their counts as ``summary``.
    """
    spark = reviews.sparkSession
    out = out or scratch_path(spark, "full-run")
    fresh = enrich.process_new_reviews(reviews, F.lit(as_of), lexicon=lexicon, stop_words=stop_words)
    known = filters.processed(reviews).unionByName(fresh, allowMissingColumns=True)
    table = tables.replace_table(known.select(*fresh.columns), f"{out}/reviews")
    measured = joins.with_stored_analytics(businesses, aggregates.business_analytics(table), as_of)
    measured = tables.replace_table(measured, f"{out}/businesses")
    trending = aggregates.trending_keywords(table, as_of, days, stop_words=stop_words, max_terms=max_terms)
    trending = tables.replace_table(trending, f"{out}/trending_keywords")
    summary = _summary(
        spark, processed_reviews=_count(filters.unprocessed(reviews)),
        updated_businesses=_count(measured, F.col("analytics").isNotNull()), trending_keywords=_count(trending))
    return {"reviews": table, "businesses": measured, "trending_keywords": trending, "summary": summary}


def anomalies(
    reviews: DataFrame, businesses: DataFrame, target: DataFrame, as_of: dt.datetime,
    ties: Sequence[str] = ("source_review_id",), **kwargs,
) -> tuple[DataFrame, DataFrame]:
    """Anomalies of all businesses upserted into the anomaly table; (new table, summary)."""
    found = stage_table(windows.rating_anomalies(reviews, ties=ties, **kwargs), "anomalies")
    records = windows.anomaly_records(found, businesses, F.lit(as_of))
    table = upsert.upsert_anomalies(target, records, [F.col("detected_at").desc()])
    return table, windows.anomaly_summary(found)


def import_places(
    raw_places: DataFrame, raw_details: DataFrame, businesses: DataFrame, reviews: DataFrame,
    as_of: dt.datetime, lexicon: Mapping[str, float], stop_words: Sequence[str] | None = None,
    days: int = 30, out: str | None = None,
) -> dict[str, DataFrame]:
    """Landed JSON to business and review tables, enriched, with analytics and trending keywords.

    Returns ``businesses``, ``reviews``, ``analytics`` and ``trending_keywords`` as written, and their counts as
    ``summary``.
    """
    spark = raw_places.sparkSession
    out = out or scratch_path(spark, "import")
    stamp = F.lit(as_of)
    found = places.businesses_from_places(raw_places).withColumns({
        "source_id": F.col("place_id"), "source": F.lit("google_places"), "last_updated": stamp})
    new_businesses = tables.replace_table(upsert.upsert_businesses(businesses, found, [F.col("place_id"), F.col("name")]), f"{out}/businesses")

    landed = places.reviews_from_places(raw_details).withColumn("business_id", F.col("place_id"))
    valid, _ = filters.split_valid(landed, ("business_id", "review_text"))
    attributes = new_businesses.select(
        F.col("source_id").alias("business_id"), F.col("category").alias("business_category"), F.col("city").alias("business_city"))
    shaped = valid.join(attributes, "business_id", "left").select(
        "source_review_id", "source", "business_id", "business_name", "business_city", "business_category",
        "reviewer_name", "rating", "review_text", "review_date", "helpful_votes")
    # the text score replaces the score that came with the landed review
    scored = enrich.enrich_reviews(shaped, lexicon, stop_words=stop_words).drop("word_count", "character_count").withColumns({
        "processed_at": stamp, "last_updated": stamp})
    new_reviews = tables.replace_table(
        upsert.upsert_reviews(reviews, scored, [F.col("review_date").desc(), F.col("review_text")]), f"{out}/reviews")

    analytics = tables.replace_table(
        joins.with_business_analytics(new_businesses.select("source_id"), aggregates.business_analytics(new_reviews)), f"{out}/analytics")
    trending = tables.replace_table(
        aggregates.trending_keywords(new_reviews, as_of, days, stop_words=stop_words), f"{out}/trending_keywords")
    summary = _summary(
        spark, businesses=_count(new_businesses), reviews=_count(new_reviews),
        analytics=_count(analytics), trending_keywords=_count(trending))
    return {"businesses": new_businesses, "reviews": new_reviews, "analytics": analytics, "trending_keywords": trending, "summary": summary}


def enrich_backlog(
    businesses: DataFrame, landed: DataFrame, reviews: DataFrame, as_of: dt.datetime,
    limit: int | None = None, order: Sequence[Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Reviews of pending businesses stored, and those businesses marked as fetched.

    ``landed`` holds review rows by ``place_id``. Returns (businesses, reviews).
    """
    pending = filters.reviews_pending(businesses, limit).withColumn("place_id", scalars.strip_prefix(F.col("source_id")))
    pending = pending.filter(F.col("place_id") != "")
    attributes = pending.select(
        "place_id", F.col("source_id").alias("business_id"), F.col("name").alias("business_name"),
        F.coalesce("category", F.lit("")).alias("business_category"), F.coalesce("city", F.lit("")).alias("business_city"))
    own = ("business_id", "business_name", "business_category", "business_city")
    arrived = landed.drop(*own).join(attributes, "place_id")
    new_reviews = _like(reviews, upsert.upsert_reviews(reviews, arrived, order or [F.col("review_date").desc()]))
    marks = pending.select("source_id", "place_id").distinct().withColumns({
        "reviews_fetched": F.lit(True), "reviews_updated": F.lit(as_of)})
    return upsert.update_columns(businesses, marks, ["source_id"]), new_reviews


def store_search(
    found: DataFrame, landed: DataFrame, businesses: DataFrame, reviews: DataFrame, as_of: dt.datetime,
    order: Sequence[Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Search results stored in the two tables. Returns (businesses, reviews).

    ``found`` holds the businesses and ``landed`` all their review rows, by ``place_id``: none is left out. The id
    of a business is its place id. A review id that comes twice is stored once, the first in ``order``.
    """
    stamp = F.lit(as_of)
    measures = ("reviews", "positive", "neutral", "negative", "avg_sentiment", "reviews_fetched")
    batch = found.drop(*measures).withColumns({
        "source": F.lit("google_places_enhanced"), "source_id": F.col("place_id"), "reviews_fetched": F.lit(True), "last_updated": stamp})
    new_businesses = upsert.upsert_businesses_by_place(businesses, batch, [F.col("name")])
    # one row per place, the one that is stored, so that no review is multiplied
    attributes = windows.latest_per_key(found, ["place_id"], [F.col("name")]).select(
        "place_id", F.col("place_id").alias("business_id"), F.col("name").alias("business_name"),
        F.col("category").alias("business_category"), F.col("city").alias("business_city"))
    own = ("business_id", "business_name", "business_category", "business_city")
    rows = landed.drop(*own).join(attributes, "place_id").drop("place_id").withColumn("source", F.lit("google_places"))
    return new_businesses, _like(reviews, upsert.upsert_reviews(reviews, rows, order or [F.col("review_date").desc()]))
