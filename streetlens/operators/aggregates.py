"""Rating, sentiment, keyword, time and market aggregates.

Measures are counts, sums, means and extremes, so Spark merges partial results in the map tasks and
a hot key costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetlens.constants import MONDAY_FIRST_DAYS, TRENDING_STOP_WORDS
from streetlens.functions import scalars
from streetlens.functions.arrays import exploded
from streetlens.operators import filters, joins, tfidf
from streetlens.operators.windows import newest_first, top_n_per_group


def _n() -> Column:
    return F.count(F.lit(1))


def _share(condition: Column) -> Column:
    """Percent of all rows that meet a condition; 0 for no rows, null conditions count as not met."""
    return F.coalesce(F.try_divide(F.count_if(condition) * 100.0, _n()), F.lit(0.0))


def _no_row_when_empty(aggregated: DataFrame, count_column: str) -> DataFrame:
    return aggregated.filter(F.col(count_column) > 0)


# -- per business and per category -----------------------------------------------------------

def business_sums(reviews: DataFrame) -> DataFrame:
    """Sums per business that add up over parts of the reviews."""
    return reviews.groupBy("business_id").agg(
        F.sum(F.col("rating").cast("double")).alias("rating_sum"), F.count("rating").alias("rated"), _n().alias("total_reviews"),
        F.sum("sentiment_score").alias("score_sum"), F.count("sentiment_score").alias("scored"),
        F.max("review_date").alias("latest_review"), F.min("review_date").alias("earliest_review"),
    )


def analytics_of(sums: DataFrame) -> DataFrame:
    """The measures of each business from its sums, of which there may be several rows."""
    whole = sums.groupBy("business_id").agg(
        *[F.sum(c).alias(c) for c in ("rating_sum", "rated", "total_reviews", "score_sum", "scored")],
        F.max("latest_review").alias("latest_review"), F.min("earliest_review").alias("earliest_review"))
    return whole.select(
        "business_id", F.try_divide("rating_sum", "rated").alias("avg_rating"), "total_reviews",
        F.try_divide("score_sum", "scored").alias("avg_sentiment"), "latest_review", "earliest_review")


def business_analytics(reviews: DataFrame) -> DataFrame:
    """Per business: mean rating, number of reviews, mean sentiment, latest and earliest review."""
    return reviews.groupBy("business_id").agg(
        F.avg("rating").alias("avg_rating"), _n().alias("total_reviews"),
        F.avg("sentiment_score").alias("avg_sentiment"),
        F.max("review_date").alias("latest_review"), F.min("review_date").alias("earliest_review"),
    )


def category_analytics(businesses: DataFrame, reviews: DataFrame, category: str, top: int | None = None) -> DataFrame:
    """The same measures over the reviews of a category's businesses (its ``top`` best-rated when given); no row when none."""
    measured = joins.category_reviews(businesses, reviews, category, top).agg(
        F.avg("rating").alias("avg_rating"), _n().alias("total_reviews"),
        F.avg("sentiment_score").alias("avg_sentiment"),
    )
    return _no_row_when_empty(measured, "total_reviews")


def business_profile(reviews: DataFrame, top_k: int = 20) -> DataFrame:
    """The analytics record of each business.

    Means, rating distribution, monthly counts and sentiment trend come from one pass over (business,
    month, rating) counts; top keywords from one over (business, keyword) counts. The collected
    lists hold ratings, months or ``top_k`` keywords, never reviews.
    """
    cells = reviews.groupBy("business_id", F.date_format("review_date", "yyyy-MM").alias("month"), "rating").agg(
        _n().alias("n"), F.sum("sentiment_score").alias("s"), F.count("sentiment_score").alias("s_n"),
        F.max("review_date").alias("latest"), F.min("review_date").alias("earliest"))
    rated = F.when(F.col("rating").isNotNull(), F.col("n"))
    measures = cells.groupBy("business_id").agg(
        F.try_divide(F.sum(F.col("rating").cast("double") * F.col("n")), F.sum(rated)).alias("avg_rating"), F.sum("n").alias("total_reviews"),
        F.try_divide(F.sum("s"), F.sum("s_n")).alias("avg_sentiment"), F.max("latest").alias("latest_review"), F.min("earliest").alias("earliest_review"))
    ratings = cells.filter(F.col("rating").between(1, 5)).groupBy("business_id", "rating").agg(F.sum("n").alias("n"))
    months = cells.filter(F.col("month").isNotNull()).groupBy("business_id", "month").agg(
        F.sum("n").alias("n"), F.try_divide(F.sum("s"), F.sum("s_n")).alias("avg_sentiment"))
    by_rating = ratings.groupBy("business_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("rating", "n")))).alias("rating_distribution"))
    by_month = months.groupBy("business_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("month", "n")))).alias("monthly_review_counts"),
        F.sort_array(F.collect_list(F.struct("month", "avg_sentiment"))).alias("sentiment_trend"))
    words = exploded(reviews, "keywords", "keyword", "business_id").groupBy("business_id", "keyword").agg(_n().alias("n"))
    best = top_n_per_group(words, ["business_id"], [F.col("n").desc(), F.col("keyword").asc()], top_k, rank_column="rank_no")
    by_word = best.groupBy("business_id").agg(
        F.sort_array(F.collect_list(F.struct("rank_no", "keyword", "n"))).alias("top_keywords"))
    return (
        measures.join(by_rating, "business_id", "left")
        .join(by_month, "business_id", "left").join(by_word, "business_id", "left")
    )


def business_stats(reviews: DataFrame, order: Sequence[str] = ("review_date", "source_review_id")) -> DataFrame:
    """Per business name: mean rating, mean sentiment, category of the first review."""
    return reviews.filter(F.col("business_name").isNotNull()).groupBy("business_name").agg(
        F.avg("rating").alias("avg_rating"), F.avg("sentiment_score").alias("avg_sentiment"),
        F.min(F.when(F.col("business_category").isNotNull(), F.struct(*order, "business_category")))["business_category"].alias("business_category"),
    )


def top_business(stats: DataFrame) -> DataFrame:
    """The best mean rating; names A to Z on ties."""
    return stats.orderBy(F.col("avg_rating").desc(), "business_name").limit(1)


# -- keywords -----------------------------------------------------------------------------------

def trending_words(
    reviews: DataFrame, as_of=None, days: int | None = 30, k: int = 50,
    stop_words: Iterable[str] = TRENDING_STOP_WORDS,
) -> DataFrame:
    """Most frequent words of the recent reviews, split at single spaces, case kept."""
    kept = reviews if days is None else filters.recent(reviews, days, as_of)
    words = exploded(kept, F.split("review_text", " "), "word").filter(~F.col("word").isin(list(stop_words)))
    return words.groupBy("word").agg(_n().alias("count")).orderBy(F.col("count").desc(), "word").limit(k)


def trending_keywords(reviews: DataFrame, as_of, days: int = 7, k: int = 100, **kwargs) -> DataFrame:
    """Keyword cloud of the last ``days``, stamped for the trending table."""
    cloud = tfidf.keyword_cloud(filters.recent(reviews, days, as_of), k, **kwargs)
    return cloud.withColumns({"generated_at": F.lit(as_of), "period_days": F.lit(days)})


def keyword_bucket(label: Column, rating: Column) -> Column:
    """positive, else negative, else neutral; a missing label is neutral, a missing rating 3."""
    label, rating = F.coalesce(label, F.lit("neutral")), F.coalesce(rating, F.lit(3))
    return (
        F.when((label == "positive") | (rating >= 4), "positive")
        .when((label == "negative") | (rating <= 2), "negative")
        .otherwise("neutral")
    )


def keyword_rows(reviews: DataFrame) -> DataFrame:
    """One row per review and keyword with the review's bucket and score."""
    bucket = keyword_bucket(F.col("sentiment_label"), F.col("rating")).alias("bucket")
    return exploded(reviews, "keywords", "keyword", bucket, "sentiment_score")


def keyword_buckets(reviews: DataFrame, k: int = 20) -> DataFrame:
    """Top ``k`` keywords over all reviews and per bucket: ``bucket``, ``keyword``, ``count``."""
    counts = keyword_rows(reviews).groupBy("bucket", "keyword").agg(_n().alias("count"))
    whole = counts.groupBy("keyword").agg(F.sum("count").alias("count")).select(F.lit("all").alias("bucket"), "keyword", "count")
    return top_n_per_group(
        counts.unionByName(whole), ["bucket"], [F.col("count").desc(), F.col("keyword").asc()], k)


def keyword_terms(reviews: DataFrame) -> DataFrame:
    """Distinct keywords per bucket."""
    return keyword_rows(reviews).groupBy("bucket").agg(F.count_distinct("keyword").alias("terms"))


def keyword_tags(reviews: DataFrame) -> DataFrame:
    """Tag of a keyword: positive if it ever occurs there, else negative, else neutral."""
    return keyword_rows(reviews).groupBy("keyword").agg(
        _n().alias("count"),
        F.when(F.bool_or(F.col("bucket") == "positive"), "positive")
        .when(F.bool_or(F.col("bucket") == "negative"), "negative").otherwise("neutral").alias("tag"),
    )


def keyword_sentiment(reviews: DataFrame, min_count: int = 3, k: int = 10) -> DataFrame:
    """Mean sentiment of frequent keywords, the ``k`` best and the ``k`` worst: ``side``."""
    means = keyword_rows(reviews).groupBy("keyword").agg(
        F.avg(F.coalesce("sentiment_score", F.lit(0.0))).alias("avg_sentiment"), _n().alias("count"),
    ).filter(F.col("count") >= min_count)
    # sums of the same scores can differ in the last bits, so ranks use a rounded mean
    score = F.round("avg_sentiment", 9)
    best = means.orderBy(score.desc(), "keyword").limit(k).withColumn("side", F.lit("most_positive"))
    worst = means.orderBy(score.asc(), F.col("keyword").desc()).limit(k).withColumn("side", F.lit("most_negative"))
    return best.unionByName(worst)


def label_words(reviews: DataFrame, label: str, k: int = 10, longer_than: int = 3) -> DataFrame:
    """The ``k`` most frequent long words of the reviews with a label."""
    labelled = reviews.filter(F.col("sentiment_label") == label)
    words = exploded(labelled, F.split(F.lower("review_text"), r"[ \t\n\x0B\f\r]+"), "word").filter(F.length("word") > longer_than)
    return words.groupBy("word").agg(_n().alias("count")).orderBy(F.col("count").desc(), "word").limit(k)


def top_keywords(reviews: DataFrame, k: int = 20) -> DataFrame:
    """Most frequent keywords with their share of all keyword occurrences."""
    counts = exploded(reviews, "keywords", "keyword").groupBy("keyword").agg(_n().alias("count"))
    total = counts.agg(F.sum("count"))
    return counts.orderBy(F.col("count").desc(), "keyword").limit(k).withColumn(
        "frequency", F.col("count") / total.scalar())


# -- whole-table measures over businesses -----------------------------------------------------------

def overall_rating(businesses: DataFrame) -> DataFrame:
    """Mean rating of all businesses and its insight label; no row when there is no business."""
    mean = F.coalesce(F.avg("rating"), F.lit(0.0))
    measured = businesses.agg(mean.alias("avg_rating"), _n().alias("n")).withColumn(
        "insight", F.when(F.col("avg_rating") >= 4.0, "good").when(F.col("avg_rating") >= 3.5, "improving").otherwise("attention"))
    return _no_row_when_empty(measured, "n").drop("n")


def category_count(businesses: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of distinct non-empty categories."""
    named = F.when(F.col("category") != "", F.col("category"))
    count = F.approx_count_distinct(named) if approximate else F.count_distinct(named)
    return businesses.agg(count.alias("categories"))


def reviews_per_business(businesses: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews divided by businesses, 0 without businesses, and the engagement level."""
    totals = businesses.agg(_n().alias("businesses")).withColumn("reviews", reviews.agg(_n()).scalar())
    ratio = F.coalesce(F.try_divide(F.col("reviews"), F.col("businesses")), F.lit(0.0))
    return totals.withColumn("reviews_per_business", ratio).withColumn(
        "level", F.when(ratio >= 100, "high").when(ratio >= 20, "medium").otherwise("low"))


def opportunity_pct(businesses: DataFrame) -> DataFrame:
    return businesses.agg(_share((F.col("rating") >= 4.0) & (F.col("review_count") < 50)).alias("opportunity_pct"))


def top_metrics(businesses: DataFrame) -> DataFrame:
    """Count, mean of non-zero ratings, sum of review counts, distinct categories."""
    return businesses.agg(
        _n().alias("businesses"), F.avg(F.nullif(F.col("rating"), F.lit(0.0))).alias("avg_rating"),
        F.coalesce(F.sum("review_count"), F.lit(0)).alias("total_reviews"),
        F.count_distinct("category").alias("categories"),
    )


def rating_histogram(businesses: DataFrame) -> DataFrame:
    return businesses.filter(F.col("rating").isNotNull()).groupBy("rating").agg(_n().alias("count"))


def category_top(businesses: DataFrame, k: int | None = 10) -> DataFrame:
    """Businesses per category, most frequent first."""
    counts = businesses.filter(F.col("category").isNotNull()).groupBy("category").agg(_n().alias("count"))
    return counts if k is None else counts.orderBy(F.col("count").desc(), "category").limit(k)


def segments(businesses: DataFrame) -> DataFrame:
    return businesses.groupBy(scalars.segment(F.col("rating"), F.col("review_count")).alias("segment")).agg(_n().alias("count"))


def market_gaps(businesses: DataFrame, k: int = 10) -> DataFrame:
    """The least frequent categories with their mean rating."""
    return (
        businesses.filter(F.col("category").isNotNull()).groupBy("category")
        .agg(_n().alias("count"), F.avg("rating").alias("avg_rating"))
        .orderBy("count", "category").limit(k)
    )


def market_concentration(businesses: DataFrame) -> DataFrame:
    """Most frequent category and its share of all businesses, in percent."""
    total = businesses.agg(_n()).scalar()
    return category_top(businesses, 1).select("category", (F.col("count") * 100.0 / total).alias("share_pct"))


def quality_share(businesses: DataFrame) -> DataFrame:
    return businesses.agg(_share(F.col("rating") >= 4.0).alias("quality_pct"))


def high_engagement(businesses: DataFrame) -> DataFrame:
    return businesses.agg(F.count_if(F.col("review_count") >= 100).alias("high_engagement"))


def hidden_gems(businesses: DataFrame) -> DataFrame:
    return businesses.agg(F.count_if((F.col("rating") >= 4.5) & (F.col("review_count") < 20)).alias("hidden_gems"))


def map_extent(businesses: DataFrame, padding: float = 0.1) -> DataFrame:
    """Extremes, centre and padded bounds of the points; bounds are null for a single point."""
    box = filters.valid_coordinates(businesses).agg(
        F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"),
        F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"), _n().alias("points"),
    )
    def pad(low: str, high: str) -> Column:
        return (F.col(high) - F.col(low)) * padding
    many = F.col("points") > 1
    return _no_row_when_empty(box, "points").withColumns({
        "center_lat": (F.col("min_lat") + F.col("max_lat")) / 2,
        "center_lon": (F.col("min_lon") + F.col("max_lon")) / 2,
        "south": F.when(many, F.col("min_lat") - pad("min_lat", "max_lat")),
        "west": F.when(many, F.col("min_lon") - pad("min_lon", "max_lon")),
        "north": F.when(many, F.col("max_lat") + pad("min_lat", "max_lat")),
        "east": F.when(many, F.col("max_lon") + pad("min_lon", "max_lon")),
    })


# -- sentiment and time -------------------------------------------------------------------------------

def sentiment_distribution(reviews: DataFrame) -> DataFrame:
    """Reviews per label and the percent of positive ones among all reviews."""
    counts = reviews.groupBy("sentiment_label").agg(_n().alias("count"))
    # a row per label: the total is a window over a few rows
    whole = Window.partitionBy(F.lit(1))
    positive = F.sum(F.when(F.col("sentiment_label") == "positive", F.col("count")).otherwise(0)).over(whole)
    return counts.withColumn("positive_pct", positive * 100.0 / F.sum("count").over(whole))


def label_counts() -> list[Column]:
    """Counts for the three labels; a missing label is neutral, other labels are ignored."""
    label = F.coalesce("sentiment_label", F.lit("neutral"))
    return [F.count_if(label == name).alias(name) for name in ("positive", "neutral", "negative")]


def label_distribution(reviews: DataFrame, keys: Sequence[str] = ("business_id",)) -> DataFrame:
    return reviews.groupBy(*keys).agg(*label_counts())


def rating_distribution(reviews: DataFrame, keys: Sequence[str] = ("business_id",)) -> DataFrame:
    """Counts for 1..5, zero-filled; other ratings are ignored."""
    return reviews.groupBy(*keys).agg(*[F.count_if(F.col("rating") == r).alias(f"rating_{r}") for r in range(1, 6)])


def avg_sentiment_zero(businesses: DataFrame, reviews: DataFrame) -> DataFrame:
    """Mean sentiment per business with missing scores as 0, and 0 without reviews."""
    means = reviews.groupBy(F.col("business_id").alias("source_id")).agg(
        F.avg(F.coalesce("sentiment_score", F.lit(0.0))).alias("avg_sentiment"))
    return businesses.select("source_id").join(means, "source_id", "left").select(
        F.col("source_id").alias("business_id"), F.coalesce("avg_sentiment", F.lit(0.0)).alias("avg_sentiment"))


def positive_pct(reviews: DataFrame, newest: int | None = None, ties: Sequence[str] = ("source_review_id",)) -> DataFrame:
    """Percent of positive reviews per business; of its newest ``newest`` when given."""
    kept = reviews if newest is None else top_n_per_group(reviews, ["business_id"], newest_first(*ties), newest)
    return kept.groupBy("business_id").agg(_share(F.col("sentiment_label") == "positive").alias("positive_pct"), _n().alias("reviews"))


def sentiment_metrics(reviews: DataFrame, threshold: float = 0.05) -> DataFrame:
    score = F.col("sentiment_score")
    return reviews.agg(
        F.avg(score).alias("avg_sentiment"), F.count_if(score > threshold).alias("positive"),
        F.count_if(score < -threshold).alias("negative"),
        F.count_if(score.between(-threshold, threshold)).alias("neutral"), _n().alias("total"),
    )


def monthly_sentiment(reviews: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Month by label counts, zero-filled, with their total."""
    month = F.date_format("review_date", "yyyy-MM").alias("month")
    labels = [F.count_if(F.col("sentiment_label") == name).alias(name) for name in ("positive", "negative", "neutral")]
    return reviews.filter(F.col("review_date").isNotNull()).groupBy(*keys, month).agg(*labels).withColumn(
        "total", F.col("positive") + F.col("negative") + F.col("neutral"))


def monthly_rating(reviews: DataFrame) -> DataFrame:
    return reviews.filter(F.col("review_date").isNotNull()).groupBy(F.date_format("review_date", "yyyy-MM").alias("month")).agg(F.avg("rating").alias("avg_rating"))


def monthly_volume(reviews: DataFrame) -> DataFrame:
    return reviews.filter(F.col("review_date").isNotNull()).groupBy(F.date_format("review_date", "yyyy-MM").alias("month")).agg(_n().alias("reviews"))


def sentiment_trend(reviews: DataFrame, period: str = "month") -> DataFrame:
    """Per month, week (Monday to Sunday) or day: mean sentiment, scored reviews, mean rating."""
    return (
        reviews.filter(F.col("review_date").isNotNull())
        .groupBy(scalars.period_label(F.col("review_date"), period).alias("period"))
        .agg(F.avg("sentiment_score").alias("avg_sentiment"), F.count("sentiment_score").alias("review_count"), F.avg("rating").alias("avg_rating"))
    )


def hourly_activity(reviews: DataFrame) -> DataFrame:
    """Reviews per hour with label, opening flag (6 to 22) and the peak (earliest on ties)."""
    hours = reviews.filter(F.col("review_date").isNotNull()).groupBy(F.hour("review_date").alias("hour")).agg(_n().alias("reviews"))
    peak = hours.agg(F.max(F.struct("reviews", (-F.col("hour")).alias("h")))["h"])
    return hours.select(
        "hour", "reviews", scalars.hour_label(F.col("hour")).alias("hour_label"),
        F.col("hour").between(6, 22).alias("open"), (F.col("hour") == -peak.scalar()).alias("peak"),
    )


def weekday_activity(reviews: DataFrame) -> DataFrame:
    """Reviews per weekday, Monday to Sunday with gaps as 0, and the busiest (first on ties)."""
    number = F.weekday("review_date")
    days = reviews.filter(F.col("review_date").isNotNull()).groupBy(number.alias("day_no")).agg(_n().alias("n"))
    names = F.array(*[F.struct(F.lit(i).alias("day_no"), F.lit(d).alias("day")) for i, d in enumerate(MONDAY_FIRST_DAYS)])
    calendar = reviews.sparkSession.range(1).select(F.inline(names))
    busiest = days.agg(F.max(F.struct("n", (-F.col("day_no")).alias("d")))["d"])
    return calendar.join(days, "day_no", "left").select(
        "day_no", "day", F.coalesce("n", F.lit(0)).alias("reviews"),
        F.coalesce(F.col("day_no") == -busiest.scalar(), F.lit(False)).alias("busiest"),
    )


def score_histogram(reviews: DataFrame, low: float = -1.0, high: float = 1.0, bins: int = 20) -> DataFrame:
    """Sentiment scores in equal bins; the upper end belongs to the last bin."""
    scored = reviews.filter(F.col("sentiment_score").isNotNull())
    # the small offset keeps scores that sit on a bin edge from falling below it by rounding error
    place = F.floor((F.col("sentiment_score") - low) / ((high - low) / bins) + 1e-9)
    return scored.groupBy(F.greatest(F.lit(0), F.least(F.lit(bins - 1), place)).cast("int").alias("bin")).agg(_n().alias("count"))


# -- competitors ----------------------------------------------------------------------------------

def competitor_metrics(businesses: DataFrame, reviews: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen businesses with the averages of all of them; unknown ids are skipped.

    Averages: rating to 2 decimals, review count cut to a whole number, sentiment to 3 decimals.
    """
    members = joins.with_competitor_sentiment(businesses, chosen, business_analytics(
        reviews.join(chosen.select("business_id").distinct(), "business_id", "left_semi")))
    market = members.agg(F.struct(
        F.round(F.avg("rating"), 2).alias("market_rating"),
        F.floor(F.avg("review_count")).alias("market_review_count"),
        F.round(F.avg("avg_sentiment"), 3).alias("market_sentiment"),
    ).alias("m"))
    return members.withColumn("m", market.scalar()).select("*", "m.*").drop("m")


def competitive_position(businesses: DataFrame, match: str = "equal") -> DataFrame:
    """Each business against all its competitors: means, differences, rank and percentile.

    Competitors are the businesses of the same category and city with another name (``match`` as in
    ``joins.competitors``). Rank = competitors rated lower + 1; percentile = (N - rank) / N * 100 with N
    counting the business itself. Missing values count as 0.

    No pair of businesses is formed: sums per (group, rating) and per (group, name, rating) give what all
    others of a group add up to, namely the group without those of the same name.
    """
    rated = businesses.select(
        F.col("source_id").alias("business_id"), F.coalesce("name", F.lit("")).alias("name"),
        F.lower("category").alias("category_key"), F.lower("city").alias("city_key"),
        F.coalesce("rating", F.lit(0.0)).alias("rating"), F.coalesce("review_count", F.lit(0)).alias("review_count"),
    ).filter(F.col("category_key").isNotNull() & F.col("city_key").isNotNull())
    group = ["category_key", "city_key"]
    cells = joins.reached(rated.groupBy(*group, "name", "rating").agg(_n().alias("n"), F.sum("review_count").alias("reviews")), match)

    def placed(keys: list[str], prefix: str) -> DataFrame:
        """Totals of the keys beside each of their ratings, and how many are rated lower."""
        sums = cells.groupBy(*keys, "rating").agg(F.sum("n").alias("n"), F.sum("reviews").alias("reviews"))
        whole = Window.partitionBy(*keys)
        below = whole.orderBy("rating").rowsBetween(Window.unboundedPreceding, -1)
        return sums.select(
            *keys, "rating", F.coalesce(F.sum("n").over(below), F.lit(0)).alias(f"{prefix}_lower"), F.sum("n").over(whole).alias(f"{prefix}_n"),
            F.sum(F.col("n") * F.col("rating")).over(whole).alias(f"{prefix}_rating"), F.sum("reviews").over(whole).alias(f"{prefix}_reviews"))

    joined = rated.join(placed(group, "all"), [*group, "rating"]).join(placed([*group, "name"], "own"), [*group, "name", "rating"])
    others = F.col("all_n") - F.col("own_n")
    lower = F.col("all_lower") - F.col("own_lower")
    total = others + 1
    return joined.filter(others > 0).select(
        "business_id", "rating", "review_count",
        ((F.col("all_rating") - F.col("own_rating")) / others).alias("avg_competitor_rating"),
        ((F.col("all_reviews") - F.col("own_reviews")) / others).alias("avg_competitor_reviews"),
        (lower + 1).alias("rating_rank"), total.alias("total_businesses"),
        ((total - (lower + 1)) * 100.0 / total).alias("percentile"),
    ).withColumns({
        "rating_diff": F.round(F.col("rating") - F.col("avg_competitor_rating"), 9),
        "review_diff": F.col("review_count") - F.col("avg_competitor_reviews"),
    })


def vs_category(businesses: DataFrame, match: str = "contains") -> DataFrame:
    """Rating minus the mean rating of all businesses whose category contains mine; 0 where that
    mean is missing or 0."""
    keyed = businesses.withColumn("category_key", F.lower("category"))
    sums = keyed.groupBy("category_key").agg(F.sum("rating").alias("s"), F.count("rating").alias("n"))
    if match == "contains":
        reach = joins.containing_values(sums, "category_key")
        sums = reach.join(sums.withColumnRenamed("category_key", "container"), "container").groupBy(
            F.col("value").alias("category_key")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    means = sums.select("category_key", F.try_divide(F.col("s"), F.col("n")).alias("category_avg"))
    return keyed.join(means, "category_key", "left").select(
        "source_id", "category", "rating", "category_avg",
        F.when(F.col("category_avg") > 0, F.coalesce("rating", F.lit(0.0)) - F.col("category_avg")).otherwise(0.0).alias("vs_category"),
    )


# -- table overviews --------------------------------------------------------------------------------

def source_counts(businesses: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per source of the businesses: businesses, reviews and their sum."""
    b = businesses.groupBy("source").agg(_n().alias("businesses"))
    r = reviews.groupBy("source").agg(_n().alias("reviews"))
    return b.alias("b").join(r.alias("r"), F.col("b.source").eqNullSafe(F.col("r.source")), "left").select(
        "b.source", "b.businesses", F.coalesce("r.reviews", F.lit(0)).alias("reviews")
    ).withColumn("total", F.col("businesses") + F.col("reviews"))


def city_top(businesses: DataFrame, k: int = 10) -> DataFrame:
    city = F.coalesce("city", F.lit("Unknown"))
    return businesses.groupBy(city.alias("city")).agg(_n().alias("count")).orderBy(F.col("count").desc(), "city").limit(k)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    parts = [df.agg(_n().alias("rows")).select(F.lit(name).alias("collection"), "rows") for name, df in tables.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result

