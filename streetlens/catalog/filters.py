"""Queries of the filters, sorts and set operations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from streetlens.catalog.base import Tables, query
from streetlens.catalog.sql import SHORT_STOP_WORDS, quoted
from streetlens.operators import filters, joins, sets, topk

B = "source_id name category city rating:d review_count:i"
R = "source_review_id seq:i business_id rating:i sentiment_score:d review_date:t"
AS_OF = dt.datetime(2001, 11, 1)
_CHAINS = ("Supplier#0000000[0-4]", "burger king")
_CHAIN_SQL = "regexp_matches(name, 'Supplier#0000000[0-4]|burger king', 'i')"


def _businesses(name: str, condition: str, fn) -> None:
    query(name, B, f"SELECT * FROM businesses WHERE {condition}", "businesses")(lambda t: fn(t.businesses))


def _reviews(name: str, condition: str, fn, view: str = "reviews") -> None:
    query(name, R, f"SELECT * FROM {view} WHERE {condition}", view)(lambda t: fn(getattr(t, view)))


_businesses("flt_category", "regexp_matches(category, 'Restaurant', 'i')", lambda b: filters.by_category(b, "Restaurant"))
_businesses("flt_city", "regexp_matches(city, 'NATION_1', 'i') OR regexp_matches(address, 'NATION_1', 'i')", lambda b: filters.by_city(b, "NATION_1"))
_reviews("flt_review_city", "regexp_matches(business_city, 'NATION_1', 'i')", lambda r: filters.by_review_city(r, "NATION_1"), "named_reviews")
_reviews("flt_review_city_contains", "contains(lower(coalesce(business_city, '')), 'nation_2')", lambda r: filters.by_review_city_contains(r, "NATION_2"), "named_reviews")
_reviews("flt_date_range", "review_date BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-06-30'",
         lambda r: filters.by_date_range(r, dt.datetime(1998, 1, 1), dt.datetime(1998, 6, 30)))
_reviews("flt_period_preset", "review_date BETWEEN TIMESTAMP '2001-08-03' AND TIMESTAMP '2001-11-01'",
         lambda r: filters.by_period(r, "last_90_days", AS_OF))
_reviews("flt_recent_days", "review_date >= TIMESTAMP '2001-10-02'", lambda r: filters.recent(r, 30, AS_OF))


@query("flt_date_range_multi", "review_id:i review_date:t", """
SELECT review_id, review_date FROM texts
WHERE review_date BETWEEN DATE '2023-03-01' AND DATE '2023-03-31'
   OR review_date + 30 BETWEEN DATE '2023-03-01' AND DATE '2023-03-31'""", "texts")
def _(t: Tables):
    dated = t.texts.withColumns({
        "day": F.col("review_date"), "review_date": F.concat(F.date_format("review_date", "yyyy-MM-dd"), F.lit("T00:00:00Z")),
        "created_at": F.date_add("review_date", 30).cast("timestamp")})
    return filters.by_any_date(dated, dt.date(2023, 3, 1), dt.date(2023, 3, 31)).withColumn("review_date", F.col("day"))


for _focus, _condition in {
    "market_leaders": "rating >= 4.0 AND review_count >= 50",
    "growth": "rating < 4.0 AND review_count >= 10",
    "competitive": "review_count >= 20",
    "customer_experience": "review_count >= 15",
    "location": "TRUE",
    "trend": "review_count >= 10",
}.items():
    _businesses(f"focus_{_focus}", _condition, lambda b, f=_focus: filters.apply_focus(b, f))

_businesses("focus_niche", "regexp_matches(name, 'organic|#0000000[13]|fitness', 'i') OR regexp_matches(category, 'organic|#0000000[13]|fitness', 'i')",
            lambda b: filters.apply_focus(b, "niche", ("organic", "#0000000[13]", "fitness")))
_businesses("flt_review_volume", "review_count >= 20 AND review_count <= 150", lambda b: filters.by_review_volume(b, 20, 150))
_businesses("flt_rating_range", "rating >= 2.5 AND rating <= 4.5", lambda b: filters.by_rating_range(b, 2.5, 4.5))
_businesses("flt_business_types", "regexp_matches(category, 'cafe|bar', 'i')", lambda b: filters.by_types(b, ["cafe", "bar"]))


def _unnamed(b):
    """Every seventh business without a name, to show how chains treat a missing name."""
    return b.withColumn("name", F.when(F.substring_index("source_id", "_", -1).cast("bigint") % 7 != 6, F.col("name")))


_UNNAMED = ("(SELECT * REPLACE (CASE WHEN CAST(split_part(source_id, '_', 2) AS BIGINT) % 7 <> 6 THEN name END AS name) FROM businesses) AS b")
query("flt_exclude_chains", B, f"SELECT * FROM {_UNNAMED} WHERE name IS NULL OR NOT {_CHAIN_SQL}", "businesses")(
    lambda t: filters.by_chain(_unnamed(t.businesses), exclude=True, only=True, patterns=_CHAINS))
query("flt_only_chains", B, f"SELECT * FROM {_UNNAMED} WHERE {_CHAIN_SQL}", "businesses")(
    lambda t: filters.by_chain(_unnamed(t.businesses), only=True, patterns=_CHAINS))

_ALL_FILTERS = dict(category="Restaurant", city="NATION_1", focus="competitive", min_reviews=5, min_rating=2.0,
                    types=["cafe", "service", "rest"], exclude_chains=True, chain_patterns=_CHAINS)
_businesses(
    "filter_businesses",
    f"""regexp_matches(category, 'Restaurant', 'i') AND (regexp_matches(city, 'NATION_1', 'i') OR regexp_matches(address, 'NATION_1', 'i'))
    AND review_count >= 20 AND review_count >= 5 AND rating >= 2.0 AND regexp_matches(category, 'cafe|service|rest', 'i') AND (name IS NULL OR NOT {_CHAIN_SQL})""",
    lambda b: filters.filter_businesses(b, **_ALL_FILTERS))
_businesses(
    "filter_businesses_overwrite",
    f"""(regexp_matches(city, 'NATION_1', 'i') OR regexp_matches(address, 'NATION_1', 'i'))
    AND review_count >= 5 AND rating >= 2.0 AND regexp_matches(category, 'cafe|service|rest', 'i') AND (name IS NULL OR NOT {_CHAIN_SQL})""",
    lambda b: filters.filter_businesses(b, mode="reference", **_ALL_FILTERS))


def _marked(reviews):
    return reviews.withColumn("processed_at", F.when(F.col("seq") % 3 == 0, F.col("review_date")))


query("flt_unprocessed", R, "SELECT * FROM reviews WHERE seq % 3 <> 0", "reviews")(lambda t: filters.unprocessed(_marked(t.reviews)))
query("flt_processed", R, "SELECT * FROM reviews WHERE seq % 3 = 0", "reviews")(lambda t: filters.processed(_marked(t.reviews)))
query("flt_reviews_pending", B, "SELECT * FROM businesses WHERE source_id IS NOT NULL AND NOT coalesce(CASE price_level WHEN 0 THEN TRUE WHEN 1 THEN FALSE END, FALSE)", "businesses")(
    lambda t: filters.reviews_pending(t.businesses.withColumn(
        "reviews_fetched", F.when(F.col("price_level") == 0, True).when(F.col("price_level") == 1, False))))
_businesses("flt_by_source", "source = 'city_search'", lambda b: filters.by_source(b, "city_search"))
_reviews("flt_by_business", "business_id = 'biz_1'", lambda r: filters.by_business(r, "biz_1"))
_reviews("flt_by_business_name", "business_name = 'Supplier#000000002'", lambda r: filters.by_business(r, name="Supplier#000000002"), "named_reviews")
_businesses("flt_category_exact", "category = 'Bar'", lambda b: filters.by_category_exact(b, "Bar"))

_BLANK = "(SELECT * REPLACE (CASE price_level WHEN 0 THEN NULL WHEN 1 THEN '' ELSE address END AS address) FROM businesses) AS b"


def _blanked(b):
    return b.withColumn("address", F.when(F.col("price_level") == 0, None).when(F.col("price_level") == 1, "").otherwise(F.col("address")))


query("validate_businesses", B + " last_updated:t", f"SELECT *, TIMESTAMP '2001-11-01' AS last_updated FROM {_BLANK} WHERE name <> '' AND address <> ''", "businesses")(
    lambda t: filters.validate_businesses(_blanked(t.businesses), F.lit(AS_OF)))
query("validate_businesses_quarantine", B + " missing:l", f"SELECT *, ['address'] AS missing FROM {_BLANK} WHERE address IS NULL OR address = ''", "businesses")(
    lambda t: filters.split_valid(_blanked(t.businesses), ("name", "address"))[1])
query("validate_reviews", "review_id:i business_id", "SELECT * FROM texts WHERE business_id <> '' AND review_text <> '' AND review_id % 5 <> 0", "texts")(
    lambda t: filters.validate_reviews(t.texts.withColumn("review_text", F.when(F.col("review_id") % 5 != 0, F.col("review_text"))), F.lit(AS_OF)))
query("flt_named", B, "SELECT * FROM businesses WHERE price_level > 1", "businesses")(
    lambda t: filters.named(t.businesses.withColumn("name", F.when(F.col("price_level") > 1, F.col("name")).when(F.col("price_level") == 1, ""))))
query("flt_valid_coords", B, "SELECT * FROM businesses WHERE price_level <> 3", "businesses")(
    lambda t: filters.valid_coordinates(t.businesses.withColumn("latitude", F.when(F.col("price_level") != 3, F.col("latitude")))))
query("project_available", "name category rating:d", "SELECT name, category, rating FROM businesses", "businesses")(
    lambda t: filters.project_available(t.businesses, ["name", "category", "rating", "stars", "visits"]))

# -- top-k -------------------------------------------------------------------------------------

_BY_RATING = "ORDER BY rating DESC NULLS LAST, source_id"
query("top_rated", B, "SELECT * FROM businesses ORDER BY rating DESC NULLS LAST, review_count DESC NULLS LAST, source_id LIMIT 20", "businesses")(
    lambda t: topk.top_rated(t.businesses))
query("top_by_category", B, f"SELECT * FROM businesses WHERE regexp_matches(category, 'Restaurant', 'i') {_BY_RATING} LIMIT 50", "businesses")(
    lambda t: topk.top_by_category(t.businesses, "Restaurant"))
query("top_filtered", B, f"SELECT * FROM businesses WHERE regexp_matches(category, 'cafe', 'i') AND review_count >= 15 {_BY_RATING} LIMIT 30", "businesses")(
    lambda t: topk.top_filtered(t.businesses, 30, category="cafe", focus="customer_experience"))
query("top_growth_potential", B, "SELECT * FROM businesses WHERE rating >= 4.0 AND review_count < (SELECT median(review_count) FROM businesses) ORDER BY rating DESC, review_count, source_id LIMIT 10", "businesses")(
    lambda t: topk.top_growth_potential(t.businesses))
query("top_k_keywords", "keyword count:i", "SELECT keyword, count(*) AS count FROM (SELECT unnest(keywords) AS keyword FROM scored) AS k GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "scored")(
    lambda t: topk.top_keywords(t.scored.select(F.explode("keywords").alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("count"))))
query("limit_records", R, "SELECT * FROM reviews ORDER BY review_date DESC, source_review_id, seq, rating, sentiment_score LIMIT 1000", "reviews")(
    lambda t: topk.limit_records(t.reviews, 1000, [F.col("review_date").desc(), "source_review_id", "seq", "rating", "sentiment_score"]))

# competitors as the SQL side sees them: pairs, ranked per business
PAIRS = """
pairs AS (SELECT b.source_id AS business_id, b.rating AS own_rating, b.review_count AS own_reviews, o.source_id, o.name, o.rating, o.review_count,
  row_number() OVER (PARTITION BY b.source_id ORDER BY coalesce(o.rating, 0) DESC, o.source_id) AS rn
  FROM businesses b JOIN businesses o ON {on} AND o.name <> b.name)"""
EQUAL = PAIRS.format(on="lower(o.category) = lower(b.category) AND lower(o.city) = lower(b.city)")
CONTAINS = PAIRS.format(on="contains(lower(o.category), lower(b.category)) AND contains(lower(o.city), lower(b.city))")
query("top_competitors", "business_id source_id rating:d", f", {CONTAINS} SELECT * FROM pairs WHERE rn <= 10", "businesses")(
    lambda t: topk.top_competitors(joins.competitors(t.businesses, match="contains")).select("business_id", F.explode("competitors").alias("c")).select("business_id", "c.source_id", "c.rating"))

# -- sets ----------------------------------------------------------------------------------------

query("set_distinct_values", "category", "SELECT DISTINCT category FROM businesses WHERE category IS NOT NULL", "businesses")(
    lambda t: sets.distinct_values(t.businesses, "category"))
query("set_union_self", "business_id source_id name rating:d review_count:i type", f""", {CONTAINS}
SELECT source_id AS business_id, source_id, name, rating, review_count, 'Your Business' AS type FROM businesses
UNION ALL SELECT business_id, source_id, name, rating, review_count, 'Competitor' FROM pairs WHERE rn <= 20""", "businesses")(
    lambda t: sets.union_with_competitors(t.businesses, joins.competitors(t.businesses, match="contains")))


@query("set_concat_sources", "search_no:i source_id name category", """
SELECT 0 AS search_no, * FROM businesses WHERE regexp_matches(category, 'restaurant', 'i')
UNION ALL SELECT 1, * FROM businesses WHERE regexp_matches(category, 'cafe|bar', 'i')
UNION ALL SELECT 2, * FROM businesses WHERE regexp_matches(category, 'bar', 'i')""", "businesses")
def _(t: Tables):
    searches = [filters.by_category(t.businesses, p) for p in ("restaurant", "cafe|bar", "bar")]
    return sets.concat_sources(searches, [F.col("source_id")])


query("set_unique_keywords", "review_id:i words:i", f"""
SELECT review_id, list_unique(list_filter(regexp_extract_all(lower(review_text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{4,}}') AND NOT list_contains([{quoted(SHORT_STOP_WORDS)}], w))) AS words FROM texts""", "texts")(
    lambda t: t.texts.select("review_id", F.size(sets.unique_keywords(_words())).alias("words")))


def _words():
    from streetlens.functions.text import simple_words

    return simple_words(F.col("review_text"))
