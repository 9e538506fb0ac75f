"""Landed place-search and place-details JSON to business and review rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetlens.constants import LEGACY_PLACE_TYPE_DEFAULT, LEGACY_PLACE_TYPE_FALLBACKS, LEGACY_PLACE_TYPES
from streetlens.functions import scalars
from streetlens.functions.arrays import exploded, occurrence_counts
from streetlens.operators import aggregates, enrich
from streetlens.operators.joins import type_category
from streetlens.schemas import LEGACY_RESPONSE, PLACE_DETAILS, PLACES_RESPONSE


def _or(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def businesses_from_places(raw: DataFrame, json_column: str = "json", query_column: str = "city_query") -> DataFrame:
    """Place-search responses to business rows, absent fields by their defaults."""
    places = exploded(raw, F.from_json(json_column, PLACES_RESPONSE)["places"], "p", F.col(query_column).alias("q"))
    kind = type_category(F.coalesce("p.types", F.array().cast("array<string>")))
    region = scalars.city_region(F.col("q"), F.coalesce("p.formattedAddress", F.lit("")))
    return places.withColumns({"kind": kind, "where": region}).select(
        _or(F.col("p.id"), "").alias("place_id"), _or(F.col("p.displayName.text"), "Unknown Business").alias("name"),
        _or(F.col("p.formattedAddress"), "No address").alias("address"),
        F.col("where.city").alias("city"), F.col("where.region").alias("state"),
        _or(F.col("p.rating"), 4.0).alias("rating"), _or(F.col("p.userRatingCount"), 0).alias("review_count"),
        F.col("kind.category").alias("category"), F.col("kind.subcategory").alias("subcategory"),
        F.col("p.nationalPhoneNumber").alias("phone"),
        _or(F.col("p.location.latitude"), 0.0).alias("latitude"), _or(F.col("p.location.longitude"), 0.0).alias("longitude"),
        scalars.price_level(F.col("p.priceLevel")).alias("price_level"),
    )


def businesses_from_legacy(raw: DataFrame, json_column: str = "json") -> DataFrame:
    """Older nearby-search responses to business rows; rows without name, id or point are dropped."""
    places = exploded(raw, F.from_json(json_column, LEGACY_RESPONSE)["results"], "p").filter(
        F.col("p.name").isNotNull() & F.col("p.place_id").isNotNull()
        & F.col("p.geometry.location.lat").isNotNull() & F.col("p.geometry.location.lng").isNotNull())
    kind = type_category(F.coalesce("p.types", F.array().cast("array<string>")),
                         LEGACY_PLACE_TYPES, LEGACY_PLACE_TYPE_FALLBACKS, LEGACY_PLACE_TYPE_DEFAULT)
    parts = F.split(_or(F.col("p.vicinity"), ""), ",")
    return places.withColumns({"kind": kind, "parts": parts}).select(
        F.col("p.place_id").alias("place_id"), F.col("p.name").alias("name"), _or(F.col("p.vicinity"), "").alias("address"),
        _or(F.trim(F.try_element_at("parts", F.lit(-2))), "").alias("city"), F.trim(F.try_element_at("parts", F.lit(-1))).alias("state"),
        _or(F.col("p.rating"), 0.0).alias("rating"), _or(F.col("p.user_ratings_total"), 0).alias("review_count"),
        F.col("kind.category").alias("category"), F.col("kind.subcategory").alias("subcategory"),
        F.col("p.geometry.location.lat").alias("latitude"), F.col("p.geometry.location.lng").alias("longitude"),
        F.col("p.price_level").alias("price_level"),
    )


def _details(raw: DataFrame, json_column: str, id_column: str) -> DataFrame:
    return raw.select(F.col(id_column).alias("place_id"), F.from_json(json_column, PLACE_DETAILS).alias("d"))


def reviews_from_places(
    raw: DataFrame, json_column: str = "json", id_column: str = "place_id", max_reviews: int | None = None,
) -> DataFrame:
    """Place-details responses to review rows with rating-based sentiment.

    The original text wins over the translated one. Of each place the first ``max_reviews`` entries of
    its response when given.
    """
    reviews = F.col("d.reviews")
    kept = reviews if max_reviews is None else F.slice(reviews, 1, max_reviews)
    rows = exploded(
        _details(raw, json_column, id_column), kept, "r", "place_id", F.col("d.displayName.text").alias("business_name"),
        F.col("d.rating").alias("business_rating"), position="position")
    body = F.coalesce(F.nullif(F.col("r.originalText.text"), F.lit("")), F.col("r.text.text"), F.lit(""))
    author, published = _or(F.col("r.authorAttribution.displayName"), "Anonymous"), _or(F.col("r.publishTime"), "")
    shaped = rows.select(
        "place_id", "position", F.lit("google_places").alias("source"),
        _or(F.col("business_name"), "Unknown Business").alias("business_name"), _or(F.col("business_rating"), 0.0).alias("business_rating"),
        author.alias("reviewer_name"), _or(F.col("r.authorAttribution.uri"), "").alias("author_url"),
        _or(F.col("r.rating"), 0).alias("rating"), body.alias("review_text"),
        F.coalesce(F.nullif(F.col("r.originalText.languageCode"), F.lit("")), F.col("r.text.languageCode"), F.lit("en")).alias("language"),
        published.alias("publish_time"), scalars.parse_date(published).alias("review_date"),
        F.lit(0).alias("helpful_votes"),
        scalars.review_key(F.col("place_id"), body, author, published).alias("source_review_id"),
    )
    return enrich.rating_sentiment_columns(shaped)


def profiles_from_places(raw: DataFrame, json_column: str = "json", id_column: str = "place_id", max_reviews: int | None = None, top_k: int = 20) -> DataFrame:
    """Place-details responses to one profile row each, with measures over its reviews and its ``top_k`` keywords."""
    reviews = reviews_from_places(raw, json_column, id_column, max_reviews)
    measures = reviews.groupBy("place_id").agg(
        F.count(F.lit(1)).alias("reviews_fetched"), F.avg("sentiment_score").alias("avg_sentiment"),
        *aggregates.label_counts(), *[F.count_if(F.col("rating") == r).alias(f"rating_{r}") for r in range(1, 6)],
        # no more entries than one landed response holds
        F.sort_array(F.collect_list(F.struct("position", "reviewer_name", "rating", "review_text", "sentiment_label", "sentiment_score"))).alias("reviews"),
        F.flatten(F.collect_list("keywords")).alias("words"),
    )
    # counted in the row of the place, which holds its reviews anyway: the responses are parsed once for all measures
    counts = F.sort_array(F.transform(occurrence_counts(F.col("words")), lambda w: F.struct((-w["n"]).alias("neg"), w["term"].alias("keyword"))))
    best = F.transform(F.slice(counts, 1, top_k), lambda w, i: F.struct(
        (i + 1).alias("rank_no"), w["keyword"].alias("keyword"), (-w["neg"]).cast("bigint").alias("count")))
    measures = measures.withColumn("top_keywords", F.when(F.size("words") > 0, best)).drop("words")
    place = scalars.city_state(_or(F.col("d.formattedAddress"), ""))
    base = _details(raw, json_column, id_column).withColumn("where", place).select(
        "place_id", _or(F.col("d.displayName.text"), "Unknown Business").alias("name"), _or(F.col("d.formattedAddress"), "").alias("address"),
        "where.city", "where.state", _or(F.col("d.location.latitude"), 0.0).alias("latitude"), _or(F.col("d.location.longitude"), 0.0).alias("longitude"),
        _or(F.col("d.rating"), 0.0).alias("rating"), _or(F.col("d.userRatingCount"), 0).alias("review_count"),
        _or(F.get(F.col("d.types"), F.lit(0)), "business").alias("category"),
        F.coalesce(F.slice(F.col("d.types"), 2, 4), F.array().cast("array<string>")).alias("subcategory"),
        _or(F.col("d.nationalPhoneNumber"), "").alias("phone"), _or(F.col("d.websiteUri"), "").alias("website"),
        F.col("d.priceLevel").alias("price_level"), scalars.hours_text(F.col("d.regularOpeningHours.periods")).alias("opening_hours"),
    )
    filled = base.join(measures, "place_id", "left")
    zero = ("reviews_fetched", "positive", "neutral", "negative", *[f"rating_{r}" for r in range(1, 6)])
    return filled.withColumns({**{c: F.coalesce(c, F.lit(0)) for c in zero}, "avg_sentiment": F.coalesce("avg_sentiment", F.lit(0.0))})
