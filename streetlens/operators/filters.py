"""Predicates and filters on businesses and reviews."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetlens.constants import CHAIN_PATTERNS, NICHE_WORDS

FOCUS_RULES = (
    "all", "market_leaders", "growth", "competitive", "niche", "customer_experience", "location", "trend",
)
_PRESET_DAYS = {"last_30_days": 30, "last_90_days": 90, "last_6_months": 180, "last_year": 365}


def matches(column: Column, pattern: str, literal: bool = False) -> Column:
    """Case-insensitive, unanchored match; ``literal`` takes the pattern as plain text."""
    if literal:
        return F.contains(F.lower(column), F.lit(pattern.lower()))
    return column.rlike(f"(?iu){pattern}")


def alternation(words: Iterable[str]) -> str:
    return "|".join(words)


# -- single predicates -------------------------------------------------------------------

def by_category(businesses: DataFrame, pattern: str, literal: bool = False) -> DataFrame:
    return businesses.filter(matches(F.col("category"), pattern, literal))


def by_city(businesses: DataFrame, city: str, literal: bool = False) -> DataFrame:
    """City or address matches."""
    return businesses.filter(matches(F.col("city"), city, literal) | matches(F.col("address"), city, literal))


def by_review_city(reviews: DataFrame, city: str, literal: bool = False) -> DataFrame:
    return reviews.filter(matches(F.col("business_city"), city, literal))


def by_review_city_contains(reviews: DataFrame, city: str) -> DataFrame:
    """Lower-case substring test; a missing city counts as ''."""
    return reviews.filter(F.contains(F.lower(F.coalesce("business_city", F.lit(""))), F.lit(city.lower())))


def by_date_range(reviews: DataFrame, start, end, business_id: str | None = None) -> DataFrame:
    """Inclusive range on ``review_date``, optionally of one business."""
    kept = reviews.filter(F.col("review_date").between(F.lit(start), F.lit(end)))
    return kept if business_id is None else kept.filter(F.col("business_id") == business_id)


def by_any_date(
    reviews: DataFrame, start: dt.date, end: dt.date,
    columns: Sequence[str] = ("date", "review_date", "created_at"),
) -> DataFrame:
    """Any of the date columns lies within the days ``start`` 00:00 to ``end`` 23:59:59.999999.

    String columns hold ISO-8601 dates and are converted first; absent columns are skipped.
    """
    low = dt.datetime.combine(start, dt.time.min)
    high = dt.datetime.combine(end, dt.time.max)
    tests = []
    for name in columns:
        if name in reviews.columns:
            value = F.col(name)
            if reviews.schema[name].dataType.typeName() == "string":
                value = value.try_cast("timestamp")
            tests.append(F.coalesce(value.between(F.lit(low), F.lit(high)), F.lit(False)))
    return reviews.filter(reduce(lambda a, b: a | b, tests)) if tests else reviews


def period_range(
    preset: str, as_of: dt.datetime, custom: Sequence[dt.datetime] | None = None
) -> tuple[dt.datetime, dt.datetime] | None:
    """Start and end of a named period; ``all_time`` gives None; one custom date runs to ``as_of``."""
    if preset == "all_time":
        return None
    if preset == "custom":
        dates = list(custom or ())
        if not dates:
            return None
        return (dates[0], dates[1] if len(dates) > 1 else as_of)
    return (as_of - dt.timedelta(days=_PRESET_DAYS[preset]), as_of)


def by_period(reviews: DataFrame, preset: str, as_of: dt.datetime, custom=None) -> DataFrame:
    bounds = period_range(preset, as_of, custom)
    return reviews if bounds is None else by_date_range(reviews, *bounds)


def recent(reviews: DataFrame, days: int, as_of: dt.datetime) -> DataFrame:
    return reviews.filter(F.col("review_date") >= F.lit(as_of - dt.timedelta(days=days)))


def by_review_volume(businesses: DataFrame, min_reviews: int | None = None, max_reviews: int | None = None) -> DataFrame:
    """Businesses within these numbers of reviews; None sets no limit."""
    tests = _volume_tests(min_reviews, max_reviews)
    return businesses.filter(_all(tests)) if tests else businesses


def by_rating_range(businesses: DataFrame, min_rating: float | None = None, max_rating: float | None = None) -> DataFrame:
    """Businesses within these ratings; None sets no limit."""
    tests = _rating_tests(min_rating, max_rating)
    return businesses.filter(_all(tests)) if tests else businesses


def by_types(businesses: DataFrame, types: Iterable[str]) -> DataFrame:
    types = list(types)
    return businesses.filter(matches(F.col("category"), alternation(types))) if types else businesses


def by_chain(
    businesses: DataFrame, exclude: bool = False, only: bool = False,
    patterns: Iterable[str] = CHAIN_PATTERNS,
) -> DataFrame:
    """Leave out chains, or keep only chains; ``exclude`` wins and keeps rows without a name."""
    test = _chain_test(exclude, only, patterns)
    return businesses if test is None else businesses.filter(test)


def apply_focus(businesses: DataFrame, focus: str, niche_words: Iterable[str] = NICHE_WORDS) -> DataFrame:
    tests = _focus_tests(focus, niche_words)
    return businesses.filter(_all(list(tests.values()))) if tests else businesses


def _all(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def _range_tests(value: Column, low: float | None, high: float | None) -> list[Column]:
    return ([value >= low] if low is not None else []) + ([value <= high] if high is not None else [])


def _volume_tests(low: int | None, high: int | None) -> list[Column]:
    return _range_tests(F.col("review_count"), low, high)


def _rating_tests(low: float | None, high: float | None) -> list[Column]:
    return _range_tests(F.col("rating"), low, high)


def _chain_test(exclude: bool, only: bool, patterns: Iterable[str]) -> Column | None:
    hit = matches(F.col("name"), alternation(patterns))
    if exclude:
        return F.col("name").isNull() | ~hit
    return hit if only else None


def _focus_tests(focus: str, niche_words: Iterable[str]) -> dict[str, Column]:
    """Tests of a focus by the slot they occupy in the combined query (see filter_businesses)."""
    rating, count = F.col("rating"), F.col("review_count")
    if focus == "market_leaders":
        return {"and": (rating >= 4.0) & (count >= 50)}
    if focus == "growth":
        return {"and": (rating < 4.0) & (count >= 10)}
    if focus == "niche":
        words = alternation(niche_words)
        return {"or": matches(F.col("name"), words) | matches(F.col("category"), words)}
    least = {"competitive": 20, "customer_experience": 15, "trend": 10}
    if focus in least:
        return {"review_count": count >= least[focus]}
    if focus in ("all", "location"):
        return {}
    raise ValueError(f"unknown focus {focus!r}")


def filter_businesses(
    businesses: DataFrame, category: str = "", city: str = "", focus: str = "all",
    min_reviews: int | None = None, max_reviews: int | None = None, min_rating: float | None = None, max_rating: float | None = None,
    types: Iterable[str] = (), exclude_chains: bool = False, only_chains: bool = False,
    chain_patterns: Iterable[str] = CHAIN_PATTERNS, niche_words: Iterable[str] = NICHE_WORDS,
    mode: str = "and", limit: int | None = None, literal: bool = False,
) -> DataFrame:
    """All business filters as one predicate.

    ``mode='and'`` joins every test. ``mode='reference'`` lets a later test take the slot of an
    earlier one: niche words replace the city test, a review range replaces the review test of the
    focus, types replace the category. ``limit`` caps in ``source_id`` order when given.
    """
    slots: dict[str, list[Column]] = {}

    def put(slot: str, *tests: Column) -> None:
        if not tests:
            return
        if mode == "reference":
            slots[slot] = list(tests)
        else:
            slots.setdefault(slot, []).extend(tests)

    if mode not in ("and", "reference"):
        raise ValueError(f"unknown mode {mode!r}")
    if category:
        put("category", matches(F.col("category"), category, literal))
    if city:
        put("or", matches(F.col("city"), city, literal) | matches(F.col("address"), city, literal))
    for slot, test in _focus_tests(focus, niche_words).items():
        put(slot, test)
    put("review_count", *_volume_tests(min_reviews, max_reviews))
    put("rating", *_rating_tests(min_rating, max_rating))
    types = list(types)
    if types:
        put("category", matches(F.col("category"), alternation(types)))
    chain = _chain_test(exclude_chains, only_chains, chain_patterns)
    if chain is not None:
        put("name", chain)
    tests = [t for group in slots.values() for t in group]
    kept = businesses.filter(_all(tests)) if tests else businesses
    kept = with_required_columns(kept)
    return kept if limit is None else kept.orderBy("source_id").limit(limit)


def with_required_columns(df: DataFrame) -> DataFrame:
    """Add absent display columns: text as 'Unknown', numbers as 0."""
    for name in ("name", "category", "city"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("Unknown"))
    for name in ("rating", "review_count"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(0))
    return df


# -- state of processing --------------------------------------------------------------------

def unprocessed(reviews: DataFrame) -> DataFrame:
    return reviews.filter(F.col("processed_at").isNull())


def processed(reviews: DataFrame) -> DataFrame:
    return reviews.filter(F.col("processed_at").isNotNull())


def reviews_pending(businesses: DataFrame, limit: int | None = None) -> DataFrame:
    """Businesses with an id whose reviews are not fetched; the first ``limit`` by id when given."""
    kept = businesses.filter(F.col("source_id").isNotNull() & ~F.coalesce("reviews_fetched", F.lit(False)))
    return kept if limit is None else kept.orderBy("source_id").limit(limit)


def by_source(df: DataFrame, source: str) -> DataFrame:
    return df.filter(F.col("source") == source)


def by_business(reviews: DataFrame, business_id: str | None = None, name: str | None = None) -> DataFrame:
    if business_id is not None:
        return reviews.filter(F.col("business_id") == business_id)
    return reviews.filter(F.col("business_name") == name)


def by_category_exact(businesses: DataFrame, category: str) -> DataFrame:
    return businesses if category == "All" else businesses.filter(F.col("category") == category)


# -- validation --------------------------------------------------------------------------------

def _present(name: str) -> Column:
    return F.coalesce(F.length(name) > 0, F.lit(False))


def split_valid(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with every required text, and the quarantined rest with the ``missing`` column names."""
    ok = _all([_present(c) for c in required])
    missing = F.array_compact(F.array(*[F.when(~_present(c), F.lit(c)) for c in required]))
    return df.filter(ok), df.filter(~ok).withColumn("missing", missing)


def validate_businesses(df: DataFrame, as_of: Column) -> DataFrame:
    valid, _ = split_valid(df, ("name", "address"))
    return valid.withColumn("last_updated", as_of)


def validate_reviews(df: DataFrame, as_of: Column) -> DataFrame:
    valid, _ = split_valid(df, ("business_id", "review_text"))
    return valid.withColumn("last_updated", as_of)


def named(df: DataFrame) -> DataFrame:
    return df.filter(_present("name"))


def valid_coordinates(df: DataFrame) -> DataFrame:
    return df.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def project_available(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.select([c for c in columns if c in df.columns])
