"""Ranking within groups, and the rating anomalies built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "__rank"
_SALT = "__salt"


def top_n_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salts: int = 64,
    rank_column: str | None = None,
) -> DataFrame:
    """First ``n`` rows of every group under a total order.

    Spark keeps only ``n`` rows per group in each map task before the exchange (WindowGroupLimit).
    For one group holding a third of a large table that still sends (map tasks x n) rows to one
    task, so the first pass ranks within (group, salt), the salt being the map task's number, and
    the second pass ranks the at most ``salts * n`` survivors. With ``n`` = 1, or ``salts`` <= 1,
    one pass is enough.
    """
    keys = list(keys)
    if n > 1 and salts > 1:
        salted = df.withColumn(_SALT, F.pmod(F.spark_partition_id(), F.lit(salts)))
        local = Window.partitionBy(*keys, _SALT).orderBy(*order)
        df = salted.withColumn(_RANK, F.row_number().over(local)).filter(F.col(_RANK) <= n).drop(_RANK, _SALT)
    name = rank_column or _RANK
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return ranked if rank_column else ranked.drop(_RANK)


def newest_first(*ties: str) -> list[Column]:
    return [F.col("review_date").desc()] + [F.col(t).desc() for t in ties]


def latest_reviews(
    reviews: DataFrame, n: int = 100, ties: Sequence[str] = ("source_review_id",), salts: int = 64,
) -> DataFrame:
    """Newest ``n`` reviews of every business."""
    return top_n_per_group(reviews, ["business_id"], newest_first(*ties), n, salts)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Last write per key; ``order`` puts the winner first."""
    return top_n_per_group(df, keys, order, 1)


def monthly_ratings(reviews: DataFrame) -> DataFrame:
    """Sums per business and month (null without a date): ``reviews``, ``rated``, ``rating_sum``.

    Missing and zero ratings count as reviews, not as rated.
    """
    rated = F.col("rating").isNotNull() & (F.col("rating") != 0)
    return reviews.groupBy("business_id", F.date_format("review_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("reviews"), F.count_if(rated).alias("rated"),
        F.coalesce(F.sum(F.when(rated, F.col("rating").cast("double"))), F.lit(0.0)).alias("rating_sum"))


def rating_anomalies(
    reviews: DataFrame, threshold: float = 0.5, newest: int | None = None, min_reviews: int = 10,
    min_per_month: int = 3, high: float = 1.0, ties: Sequence[str] = ("source_review_id",),
    salts: int = 64,
) -> DataFrame:
    """Monthly rating jumps of every business, against its previous qualifying month.

    Columns: business_id, month (yyyy-MM), previous_rating, current_rating, rating_change, type,
    severity. Values are not rounded. All reviews count; only the ``newest`` of each business when given.
    """
    if newest is not None:
        reviews = latest_reviews(reviews.select("business_id", "review_date", "rating", *ties), newest, ties, salts)
    return anomalies_of(monthly_ratings(reviews), threshold, min_reviews, min_per_month, high)


def anomalies_of(
    monthly: DataFrame, threshold: float = 0.5, min_reviews: int = 10, min_per_month: int = 3, high: float = 1.0,
) -> DataFrame:
    """The same from monthly sums (one row per business and month): no review is sorted or moved."""
    by_business = Window.partitionBy("business_id")
    qualifying = (
        monthly.withColumn("n", F.sum("reviews").over(by_business))
        .filter((F.col("n") >= min_reviews) & (F.col("rated") >= min_per_month) & F.col("month").isNotNull())
        .select("business_id", "month", (F.col("rating_sum") / F.col("rated")).alias("current_rating"))
    )
    previous = F.lag("current_rating").over(by_business.orderBy("month"))
    change = F.col("current_rating") - F.col("previous_rating")
    return (
        qualifying.withColumn("previous_rating", previous)
        .withColumn("rating_change", change)
        .filter(F.abs("rating_change") >= threshold)
        .select(
            "business_id", "month", "previous_rating", "current_rating", "rating_change",
            F.when(F.col("rating_change") > 0, "increase").otherwise("decrease").alias("type"),
            F.when(F.abs("rating_change") >= high, "high").otherwise("medium").alias("severity"),
        )
    )


def anomaly_records(anomalies: DataFrame, businesses: DataFrame, as_of: Column) -> DataFrame:
    """One row per business with its anomalies as an array ordered by month, values to 2 decimals.

    The array holds at most one entry per month.
    """
    entry = F.struct(
        "month", F.bround("rating_change", 2).alias("rating_change"),
        F.bround("previous_rating", 2).alias("previous_rating"),
        F.bround("current_rating", 2).alias("current_rating"), "type", "severity",
    )
    nested = anomalies.groupBy("business_id").agg(F.sort_array(F.collect_list(entry)).alias("anomalies"))
    names = businesses.select(F.col("source_id").alias("business_id"), F.col("name").alias("business_name"))
    return nested.join(names, "business_id").select("business_id", "business_name", "anomalies", as_of.alias("detected_at"))


def anomaly_summary(anomalies: DataFrame) -> DataFrame:
    """Number of anomalies and of businesses affected."""
    return anomalies.agg(
        F.count(F.lit(1)).alias("total_anomalies"),
        F.count_distinct("business_id").alias("businesses_affected"),
    )


def top_per_category(businesses: DataFrame, k: int | None = None) -> DataFrame:
    """Best-rated business of each category; of the first ``k`` categories A to Z when given."""
    best = top_n_per_group(
        businesses.filter(F.col("category").isNotNull() & F.col("rating").isNotNull()),
        ["category"], [F.col("rating").desc(), F.col("source_id").asc()], 1,
    )
    shown = best.select("name", "category", "rating", "review_count")
    return shown if k is None else shown.orderBy("category").limit(k)


def category_percentiles(businesses: DataFrame, mode: str = "reference") -> DataFrame:
    """Rank and percentile of each business among the others of its category.

    ``reference``: rank = businesses rated lower + 1 and percentile = (N - rank) / N * 100, which
    gives the best business the lowest percentile. ``percent_rank`` = share rated lower, in percent.
    Missing ratings count as 0.

    Only (category, rating) counts are ranked, not the rows, so a hot category stays small.
    """
    rated = businesses.withColumn("rating", F.coalesce("rating", F.lit(0.0)))
    counts = rated.groupBy("category", "rating").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("category")
    below = Window.partitionBy("category").orderBy("rating").rowsBetween(Window.unboundedPreceding, -1)
    positions = counts.select(
        "category", "rating",
        F.coalesce(F.sum("n").over(below), F.lit(0)).alias("lower"),
        F.sum("n").over(whole).alias("total"),
    )
    if mode == "reference":
        rank = F.col("lower") + 1
        percentile = (F.col("total") - rank) / F.col("total") * 100
    elif mode == "percent_rank":
        rank = F.col("lower") + 1
        percentile = F.coalesce(F.try_divide(F.col("lower"), F.col("total") - 1) * 100, F.lit(0.0))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    ranked = positions.select(
        "category", "rating", rank.alias("rating_rank"), F.col("total").alias("total_businesses"),
        percentile.alias("percentile"),
    )
    joined = rated.alias("b").join(
        ranked.alias("r"),
        F.col("b.category").eqNullSafe(F.col("r.category")) & (F.col("b.rating") == F.col("r.rating")),
    )
    return joined.select(
        "b.source_id", "b.category", "b.rating", "r.rating_rank", "r.total_businesses", "r.percentile"
    )
