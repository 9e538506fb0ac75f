"""Joins between businesses, reviews and small fixed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetlens.constants import (
    EARTH_RADIUS_M, GAZETTEER, LEGACY_GAZETTEER, PLACE_TYPE_DEFAULT, PLACE_TYPE_FALLBACKS, PLACE_TYPES,
)
from streetlens.functions.arrays import exploded, let
from streetlens.functions.scalars import clean_city
from streetlens.operators import topk
from streetlens.operators.bitmaps import bit_map
from streetlens.operators.filters import by_category, by_review_city, filter_businesses
from streetlens.operators.windows import newest_first, top_n_per_group
from streetlens.session import stage_table
from streetlens.tasks.substrings import keyword_hasher, ladder, listed_counter, piece_counter


def with_business_analytics(businesses: DataFrame, analytics: DataFrame) -> DataFrame:
    """Attach per-business review measures; businesses without a review drop out."""
    return businesses.join(
        analytics.withColumnRenamed("business_id", "source_id"), "source_id", "inner"
    )


def with_stored_analytics(businesses: DataFrame, analytics: DataFrame, as_of, business_id: str | None = None) -> DataFrame:
    """Businesses with their measures as the struct ``analytics`` and the time they were taken.

    Only the business ``business_id`` when given; the others keep what they hold, if anything.
    """
    fields = [c for c in analytics.columns if c != "business_id"]
    found = analytics if business_id is None else analytics.filter(F.col("business_id") == business_id)
    record = found.select(F.col("business_id").alias("source_id"), F.struct(*fields).alias("new_analytics"))
    joined = businesses.join(record, "source_id", "left")
    held = {c: F.col(c) if c in businesses.columns else F.lit(None) for c in ("analytics", "analytics_updated")}
    return joined.withColumns({
        "analytics": F.coalesce("new_analytics", held["analytics"]),
        "analytics_updated": F.when(F.col("new_analytics").isNotNull(), F.lit(as_of)).otherwise(held["analytics_updated"]),
    }).drop("new_analytics")


def with_competitor_sentiment(businesses: DataFrame, chosen: DataFrame, analytics: DataFrame) -> DataFrame:
    """The chosen businesses that exist, with their sentiment, 0 when they have no reviews.

    ``chosen`` has one column ``business_id``; unknown ids drop out.
    """
    picked = businesses.join(chosen.select(F.col("business_id").alias("source_id")).distinct(), "source_id", "left_semi")
    scores = analytics.select(F.col("business_id").alias("source_id"), "avg_sentiment")
    return picked.join(scores, "source_id", "left").select(
        F.col("source_id").alias("business_id"), "name",
        F.coalesce("rating", F.lit(0.0)).alias("rating"),
        F.coalesce("review_count", F.lit(0)).alias("review_count"),
        F.coalesce("avg_sentiment", F.lit(0.0)).alias("avg_sentiment"),
        "category", "price_level",
    )


def category_reviews(businesses: DataFrame, reviews: DataFrame, category: str, top: int | None = None) -> DataFrame:
    """Reviews of the businesses of a category; of its ``top`` best-rated ones when given."""
    chosen = by_category(businesses, category) if top is None else topk.top_by_category(businesses, category, top)
    return reviews.join(chosen.select(F.col("source_id").alias("business_id")), "business_id", "left_semi")


def by_names(reviews: DataFrame, names: DataFrame, anti: bool = False) -> DataFrame:
    """Reviews whose ``business_name`` is (not) among ``names.name``."""
    wanted = names.select(F.col("name").alias("business_name")).distinct()
    return reviews.join(wanted, "business_name", "left_anti" if anti else "left_semi")


def top_business_reviews(
    businesses: DataFrame, reviews: DataFrame, m: int = 50, n: int = 20,
    ties: Sequence[str] = ("source_review_id",), salts: int = 64, **business_filters,
) -> DataFrame:
    """Newest ``n`` reviews of each of the ``m`` best-rated businesses."""
    best = topk.top_filtered(businesses, m, **business_filters).select(F.col("source_id").alias("business_id"))
    kept = reviews.join(best, "business_id", "left_semi")
    return top_n_per_group(kept, ["business_id"], newest_first(*ties), n, salts)


def get_reviews(
    businesses: DataFrame, reviews: DataFrame, category: str = "", city: str = "", limit: int | None = None,
    ties: Sequence[str] = ("source_review_id",), literal: bool = False, **business_filters,
) -> DataFrame:
    """Reviews under the business filters; the newest ``limit`` of them when given.

    With a category: those of its businesses that pass the filters. Without one: all reviews, or those of
    a city by ``business_city``.
    """
    if category:
        chosen = filter_businesses(businesses, category=category, city=city, literal=literal, **business_filters)
        kept = reviews.join(chosen.select(F.col("source_id").alias("business_id")), "business_id", "left_semi")
    else:
        kept = by_review_city(reviews, city, literal) if city else reviews
    return kept if limit is None else kept.orderBy(*newest_first(*ties)).limit(limit)


def denormalise(reviews: DataFrame, businesses: DataFrame) -> DataFrame:
    """Copy name, category and city of the business onto each review; nulls where it is unknown."""
    attributes = businesses.select(
        F.col("source_id").alias("business_id"), F.col("name").alias("business_name"),
        F.col("category").alias("business_category"), F.col("city").alias("business_city"),
    )
    return reviews.join(attributes, "business_id", "left")


def pair_compare(businesses: DataFrame, pairs: DataFrame) -> DataFrame:
    """Two businesses side by side for every row (``first_id``, ``second_id``) of ``pairs``."""
    def side(prefix: str, id_column: str) -> DataFrame:
        return businesses.select(
            F.col("source_id").alias(id_column),
            *[F.col(c).alias(f"{prefix}_{c}") for c in ("name", "rating", "review_count", "price_level")],
        )
    return pairs.join(side("first", "first_id"), "first_id").join(side("second", "second_id"), "second_id")


# -- competitors -------------------------------------------------------------------------

_FIELDS = ("source_id", "name", "rating", "review_count", "price_level")


def containing_values(values: DataFrame, column: str) -> DataFrame:
    """For every distinct value, the distinct values that contain it (itself included).

    Columns ``value``, ``container``. Every substring of a container is looked up with an equi
    join, so no value is compared with all others; the cost is the square of a value's length.
    """
    distinct = values.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).distinct()
    n = F.length("value")
    # only substrings of lengths that occur among the values
    lengths = distinct.select(n.alias("n")).distinct().agg(F.collect_set("n")).scalar()
    sized = distinct.withColumn("lengths", lengths)
    parts = F.array_distinct(F.flatten(F.transform(
        F.filter("lengths", lambda m: m <= n),
        lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: F.substring(F.col("value"), i, m)))))
    pieces = exploded(sized, parts, "value", F.col("value").alias("container"))
    return pieces.join(distinct, "value")


def reached(rows: DataFrame, match: str) -> DataFrame:
    """Rows of (category_key, city_key) groups dealt to every group that reaches them."""
    if match == "equal":
        return rows
    if match != "contains":
        raise ValueError(f"unknown match {match!r}")
    groups = rows.select("category_key", "city_key").distinct()
    categories = containing_values(groups, "category_key").select(
        F.col("value").alias("category_key"), F.col("container").alias("category_other"))
    cities = containing_values(groups, "city_key").select(
        F.col("value").alias("city_key"), F.col("container").alias("city_other"))
    other = rows.withColumnRenamed("category_key", "category_other").withColumnRenamed("city_key", "city_other")
    reach = groups.join(categories, "category_key").join(cities, "city_key")
    return reach.join(other, ["category_other", "city_other"]).drop("category_other", "city_other")


def competitors(businesses: DataFrame, k: int = 20, match: str = "equal") -> DataFrame:
    """Up to ``k`` competitors of every business: same category and city, another name.

    Best-rated first, then by id. ``match='equal'`` compares lower-cased category and city;
    ``'contains'`` asks that the competitor's category and city contain mine (what an unanchored
    pattern match does with plain text). Result: ``business_id`` and the array ``competitors``.

    Pairs inside a group are never formed. A business with name X needs the first ``k`` rows of its
    group not named X. Those rows are among the first ``k`` of their own name, and after cutting each
    name to ``k`` rows at most ``k`` rows named X can stand before them: the first ``2k`` of the cut
    group hold the answer for every X. Each group therefore becomes one row of at most ``2k``
    candidates, joined to its businesses.
    """
    order = [F.coalesce("rating", F.lit(0.0)).desc(), F.col("source_id").asc()]
    keyed = businesses.select(
        *_FIELDS, F.lower("category").alias("category_key"), F.lower("city").alias("city_key"),
    ).filter(F.col("category_key").isNotNull() & F.col("city_key").isNotNull())
    group = ["category_key", "city_key"]
    cut = _candidates(keyed, group, order, k)
    if match != "equal":
        cut = _candidates(reached(cut, match), group, order, k)
    candidate = F.struct((-F.coalesce("rating", F.lit(0.0))).alias("rank_key"), *[F.col(c) for c in _FIELDS])
    lists = cut.groupBy(*group).agg(F.sort_array(F.collect_list(candidate)).alias("candidates"))
    mine = F.coalesce("name", F.lit(""))
    own = F.slice(F.filter("candidates", lambda c: F.coalesce(c["name"], F.lit("")) != mine), 1, k)
    return keyed.join(lists, group).select(
        F.col("source_id").alias("business_id"), "name", "rating", "review_count",
        own.alias("competitors"),
    )


#: Values that one pattern is tested against in one row.
VALUE_BLOCK = 1024


def matching_values(patterns: DataFrame, pattern_column: str, values: DataFrame, value_column: str) -> DataFrame:
    """``pattern``, ``value``: every different value that every different pattern is found in, letter case aside.

    Each pattern is tested once on each value, wherever they come from and however many rows have them. Values are put
    into blocks of ``VALUE_BLOCK`` by hash and patterns are sent to every block, so no task holds all values. A pattern
    that is no regular expression raises an error; nulls take no part.
    """
    known = values.select(F.col(value_column).alias("value")).filter(F.col("value").isNotNull()).distinct()
    blocks = F.greatest(F.lit(1).cast("bigint"), F.ceil(known.agg(F.count(F.lit(1)) / VALUE_BLOCK).scalar()).cast("bigint"))
    packed = known.groupBy(F.pmod(F.xxhash64("value"), blocks).alias("block")).agg(F.collect_list("value").alias("values"))
    asked = patterns.select(F.col(pattern_column).alias("pattern")).filter(F.col("pattern").isNotNull()).distinct()
    sent = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    pairs = exploded(sent.join(packed, "block"), "values", "value", "pattern")
    return pairs.filter(F.rlike("value", F.concat(F.lit("(?i)"), F.col("pattern"))))


def competitors_by_pattern(requests: DataFrame, businesses: DataFrame, k: int = 20, request_id: str = "request_id") -> DataFrame:
    """Up to ``k`` best-rated businesses for each request whose category and city its two patterns are found in.

    ``requests`` has ``request_id``, ``name``, ``category_pattern`` and ``city_pattern`` (regular expressions, found
    anywhere, letter case aside); businesses of the request's own name are left out. Best-rated first, then by id.
    Result: the request's columns and the array ``competitors``, empty where nothing matches; a request with a null
    pattern finds nothing. A pattern that is no regular expression raises an error.

    Patterns are tested on the different categories and cities alone. Each (category, city) is cut to the ``2 k``
    candidates that any request can need (see :func:`competitors`), these are joined to the pairs of patterns that reach
    them and cut again; no pair of businesses is formed.
    """
    order = [F.coalesce("rating", F.lit(0.0)).desc(), F.col("source_id").asc()]
    keyed = businesses.select(*_FIELDS, F.col("category").alias("category_key"), F.col("city").alias("city_key"))
    cut = _candidates(keyed.filter(F.col("category_key").isNotNull() & F.col("city_key").isNotNull()), ["category_key", "city_key"], order, k)
    group = ["category_pattern", "city_pattern"]
    pairs = requests.select(*group).distinct()
    categories = matching_values(pairs, "category_pattern", businesses, "category").toDF("category_pattern", "category_key")
    cities = matching_values(pairs, "city_pattern", businesses, "city").toDF("city_pattern", "city_key")
    reach = pairs.join(categories, "category_pattern").join(cities, "city_pattern")
    best = _candidates(reach.join(cut, ["category_key", "city_key"]), group, order, k)
    candidate = F.struct((-F.coalesce("rating", F.lit(0.0))).alias("rank_key"), *[F.col(c) for c in _FIELDS])
    lists = best.groupBy(*group).agg(F.sort_array(F.collect_list(candidate)).alias("candidates"))
    mine = F.coalesce(F.col("name"), F.lit(""))
    own = F.slice(F.filter("candidates", lambda c: F.coalesce(c["name"], F.lit("")) != mine), 1, k)
    joined = requests.join(lists, group, "left")
    none = F.array().cast(lists.schema["candidates"].dataType)
    return joined.select(*requests.columns, F.coalesce(own, none).alias("competitors"))


def _candidates(rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    per_name = top_n_per_group(rows, [*group, "name"], order, k)
    return top_n_per_group(per_name, list(group), order, 2 * k)


# -- small fixed tables --------------------------------------------------------------------

def type_category(types: Column, mapping=PLACE_TYPES, fallbacks=PLACE_TYPE_FALLBACKS, default=PLACE_TYPE_DEFAULT) -> Column:
    """``struct<category, subcategory>`` of the first known place type, else a fallback group."""
    def pair(entry) -> Column:
        name, sub = entry
        return F.struct(F.lit(name).alias("category"), F.array(*[F.lit(s) for s in sub]).alias("subcategory"))

    known = F.filter(types, lambda t: t.isin(list(mapping)))
    rest = pair(default)
    for group, entry in reversed(fallbacks):
        rest = F.when(F.arrays_overlap(types, F.array(*[F.lit(g) for g in group])), pair(entry)).otherwise(rest)

    def pick(first: Column) -> Column:
        result = rest
        for name, entry in mapping.items():
            result = F.when(first == name, pair(entry)).otherwise(result)
        return result

    return let(F.get(known, F.lit(0)), pick)


def geocode(df: DataFrame, query_column: str) -> DataFrame:
    """Coordinates of a city query by its cleaned first part; unknown cities give nulls.

    The broadcast side is the fixed gazetteer of a few dozen rows.
    """
    table = df.sparkSession.createDataFrame(
        list(GAZETTEER), "clean_city string, lat double, lng double, formatted_address string")
    return df.withColumn("clean_city", clean_city(F.col(query_column))).join(F.broadcast(table), "clean_city", "left")


def geocode_contains(query: Column, entries=LEGACY_GAZETTEER) -> Column:
    """First gazetteer entry whose key contains, or is contained in, the query; order decides."""
    lowered = F.lower(query)
    table = F.array(*[
        F.struct(F.lit(key).alias("key"), F.lit(lat).alias("lat"), F.lit(lng).alias("lng"), F.lit(label).alias("formatted_address"))
        for key, lat, lng, label in entries
    ])
    return let(lowered, lambda q: F.get(F.filter(table, lambda e: F.contains(q, e["key"]) | F.contains(e["key"], q)), F.lit(0)))


# -- distance --------------------------------------------------------------------------------

def distance_m(lon: Column, lat: Column, to_lon: float, to_lat: float) -> Column:
    """Great-circle distance in metres (haversine)."""
    d_lat = F.radians(lat - to_lat) / 2
    d_lon = F.radians(lon - to_lon) / 2
    a = F.sin(d_lat) * F.sin(d_lat) + F.cos(F.radians(lat)) * F.cos(F.radians(F.lit(to_lat))) * F.sin(d_lon) * F.sin(d_lon)
    return F.asin(F.sqrt(F.least(F.lit(1.0), a))) * (2 * EARTH_RADIUS_M)


def near(businesses: DataFrame, longitude: float, latitude: float, max_distance: float = 5000, k: int | None = None) -> DataFrame:
    """Businesses within ``max_distance`` metres; the ``k`` nearest, in order, when given.

    A latitude band on the plain column reaches the scan before any trigonometry runs.
    """
    import math

    band = math.degrees(max_distance / EARTH_RADIUS_M) * (1 + 1e-9)
    found = (
        businesses.filter(F.col("latitude").between(latitude - band, latitude + band))
        .withColumn("distance_m", distance_m(F.col("longitude"), F.col("latitude"), longitude, latitude))
        .filter(F.col("distance_m") <= max_distance)
    )
    return found if k is None else found.orderBy("distance_m", "source_id").limit(k)


# -- nesting and text --------------------------------------------------------------------------

def nest_reviews(
    businesses: DataFrame, reviews: DataFrame, n: int = 20, ties: Sequence[str] = ("source_review_id",),
    salts: int = 64,
) -> DataFrame:
    """Each business with an array of its newest ``n`` reviews, and measures over all its reviews."""
    newest = top_n_per_group(reviews, ["business_id"], newest_first(*ties), n, salts, rank_column="review_no")
    columns = [c for c in newest.columns if c not in ("business_id", "review_no")]
    nested = newest.groupBy("business_id").agg(
        F.sort_array(F.collect_list(F.struct("review_no", *columns))).alias("reviews"),
    ).withColumnRenamed("business_id", "source_id")
    measures = reviews.groupBy("business_id").agg(
        F.count(F.lit(1)).alias("reviews_fetched"),
        F.avg(F.coalesce("sentiment_score", F.lit(0.0))).alias("avg_sentiment"),
        *[F.count_if(F.coalesce("sentiment_label", F.lit("neutral")) == s).alias(s) for s in ("positive", "neutral", "negative")],
    ).withColumnRenamed("business_id", "source_id")
    joined = businesses.join(measures, "source_id", "left").join(nested, "source_id", "left")
    zero = ("reviews_fetched", "positive", "neutral", "negative")
    return joined.withColumns({
        **{c: F.coalesce(c, F.lit(0)) for c in zero},
        "avg_sentiment": F.coalesce("avg_sentiment", F.lit(0.0)),
        "reviews": F.coalesce("reviews", F.array().cast(nested.schema["reviews"].dataType)),
    })


#: Keywords for which every review is searched one by one; more of them are found by their hashes.
LISTED_KEYWORDS = 256
#: Keywords whose bit map is sent to the tasks at once, and its size at most; more of them are looked for block by block.
SENT_KEYWORDS, KEYWORD_BITS = 32 << 20, 1 << 29


def _listed_counts(keywords: list[bytes], texts: DataFrame) -> DataFrame:
    found = texts.mapInArrow(listed_counter(keywords), "text binary, n bigint").groupBy("text").agg(F.sum("n").alias("count"))
    return found.select(F.col("text").cast("string").alias("text"), "count")


def _hashed_counts(keywords: DataFrame, texts: DataFrame) -> DataFrame:
    words = stage_table(keywords.select("text").filter(F.length("text") > 0).distinct(), "keywords")
    sizes = [r.size for r in words.select(F.octet_length("text").alias("size")).distinct().collect()]
    counts = keywords.filter("text = ''").select("text").distinct().withColumn("count", texts.filter("body is not null").agg(F.count(F.lit(1))).scalar())
    if not sizes:
        return counts
    blocks = max(1, -(-words.count() // SENT_KEYWORDS))
    for number in range(blocks):
        part = words.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == number) if blocks > 1 else words
        hashed = stage_table(part.mapInArrow(keyword_hasher([step for step, _ in ladder(sizes)]), "text string, h bigint"), "keyword-hashes")
        named, beginnings = hashed.filter("text is not null"), hashed.filter("text is null").select("h").distinct()
        sent = bit_map(named, named.count(), KEYWORD_BITS), bit_map(beginnings, beginnings.count(), KEYWORD_BITS)
        found = texts.mapInArrow(piece_counter(sizes, *sent), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("count"))
        counts = counts.unionByName(named.join(found, "h").select("text", "count"))
    return counts


def keyword_review_counts(keywords: DataFrame, reviews: DataFrame, text_column: str = "review_text") -> DataFrame:
    """Number of reviews whose lower-cased text contains each keyword anywhere; 0 is kept.

    ``keywords`` has a column ``text``; its other columns and repeated rows stay. Up to ``LISTED_KEYWORDS`` are sent to
    the tasks, which search each text for each. More of them are told by 64-bit hashes: a task hashes the pieces of its texts that are as
    long as a keyword, counts in how many texts each stands, and only these sums are exchanged and meet the keywords. Bit
    maps of the hashes and of how keywords begin are sent before, so that few pieces are looked at. The texts are read once
    for each ``SENT_KEYWORDS``; no pair of a keyword and a review is formed, no text is exchanged. A null keyword has 0, an
    empty one is in every text.
    """
    texts = reviews.select(F.lower(text_column).alias("body"))
    listed = [r.text for r in keywords.select(F.col("text").cast("binary").alias("text")).distinct().limit(LISTED_KEYWORDS + 1).collect()]
    if len(listed) <= LISTED_KEYWORDS:
        counts = _listed_counts([bytes(k) for k in listed if k is not None], texts)
    else:
        counts = _hashed_counts(keywords, texts)
    counts = counts.withColumnRenamed("text", "counted")
    joined = keywords.join(counts, F.col("text") == F.col("counted"), "left").drop("counted")
    return joined.withColumn("count", F.coalesce("count", F.lit(0)))
