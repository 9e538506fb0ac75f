"""Insight rules: one row per rule that fires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetlens.operators.aggregates import label_counts


def _insight(when: Column, kind: str, title: str, value: Column) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(title).alias("title"), value.cast("double").alias("value")))


def improvement(businesses: DataFrame, reviews: DataFrame) -> DataFrame:
    """Insights for every business that has reviews: satisfaction, rating, review volume."""
    shares = reviews.groupBy("business_id").agg(F.count(F.lit(1)).alias("n"), *label_counts()).select(
        F.col("business_id").alias("source_id"),
        (F.col("positive") * 100.0 / F.col("n")).alias("positive_pct"),
        (F.col("negative") * 100.0 / F.col("n")).alias("negative_pct"),
    )
    good, bad = F.col("positive_pct"), F.col("negative_pct")
    rating, count = F.coalesce("rating", F.lit(0.0)), F.coalesce("review_count", F.lit(0))
    insights = F.array_compact(F.array(
        _insight(good >= 80, "success", "excellent_satisfaction", good),
        _insight((good >= 60) & (good < 80), "info", "good_satisfaction", good),
        _insight(good < 60, "warning", "satisfaction_needs_attention", bad),
        _insight(rating < 4.0, "warning", "rating_improvement_opportunity", rating),
        _insight(rating >= 4.5, "success", "excellent_rating", rating),
        _insight(count < 50, "info", "increase_review_volume", count),
    ))
    return businesses.join(shares, "source_id").select(
        F.col("source_id").alias("business_id"), F.explode_outer(insights).alias("i")).filter(F.col("i").isNotNull()).select("business_id", "i.*")


def competitive(position: DataFrame) -> DataFrame:
    """Sign of the rating and review differences and the percentile tier of each business."""
    def sign(diff: str, above: str, same: str, below: str) -> Column:
        return F.when(F.col(diff) > 0, above).when(F.col(diff) == 0, same).otherwise(below)

    return position.select(
        "business_id",
        sign("rating_diff", "rating_advantage", "on_par", "opportunity").alias("rating_insight"),
        sign("review_diff", "review_leader", "average_volume", "growth_opportunity").alias("review_insight"),
        F.when(F.col("percentile") >= 80, "top").when(F.col("percentile") >= 60, "strong").otherwise("room_to_grow").alias("position_tier"),
    )
