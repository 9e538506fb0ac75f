"""Queries of the joins and window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from streetlens.catalog.base import Tables, query
from streetlens.catalog.aggregates import CATEGORY_SEMI, TIES
from streetlens.catalog.filters import CONTAINS, EQUAL
from streetlens.catalog.sql import STOP_WORDS, quoted
from streetlens.constants import GAZETTEER, LEGACY_GAZETTEER, LEGACY_PLACE_TYPES, PLACE_TYPES
from streetlens.functions import text
from streetlens.functions.arrays import exploded
from streetlens.operators import aggregates, joins, spatial, windows
from streetlens.session import stage_table

R = "source_review_id seq:i business_id rating:i sentiment_score:d review_date:t"
NEWEST = "ORDER BY review_date DESC, source_review_id DESC, seq DESC, sentiment_score DESC, rating DESC"
ALL_TIES = (*TIES, "sentiment_score", "rating")

# -- joins -----------------------------------------------------------------------------------

query("jn_business_reviews", "source_id name avg_rating:d total_reviews:i", """
SELECT source_id, any_value(name) AS name, avg(r.rating) AS avg_rating, count(*) AS total_reviews FROM more_businesses JOIN reviews r ON r.business_id = source_id
GROUP BY 1""", "more_businesses reviews")(
    lambda t: joins.with_business_analytics(t.more_businesses, aggregates.business_analytics(t.reviews)))
query("jn_competitor_reviews", "business_id name rating:d review_count:i avg_sentiment:d", """
SELECT source_id AS business_id, any_value(name) AS name, coalesce(any_value(b.rating), 0) AS rating, any_value(review_count) AS review_count, coalesce(avg(sentiment_score), 0) AS avg_sentiment
FROM more_businesses b LEFT JOIN reviews r ON r.business_id = source_id WHERE b.category IN ('Cafe', 'Bar', 'Fitness') GROUP BY 1""", "more_businesses reviews")(
    lambda t: joins.with_competitor_sentiment(
        t.more_businesses, t.more_businesses.filter(F.col("category").isin("Cafe", "Bar", "Fitness")).select(F.col("source_id").alias("business_id")),
        aggregates.business_analytics(t.reviews)))
query("jn_category_semi", R, f"SELECT * FROM reviews r WHERE {CATEGORY_SEMI}", "businesses reviews")(
    lambda t: joins.category_reviews(t.businesses, t.reviews, "Restaurant"))
_NAMES = "(SELECT name FROM businesses WHERE city = 'NATION_1')"
query("jn_name_semi", R, f"SELECT * FROM named_reviews WHERE business_name IN {_NAMES}", "named_reviews")(
    lambda t: joins.by_names(t.named_reviews, t.businesses.filter("city = 'NATION_1'")))
query("jn_name_anti", R, f"SELECT * FROM named_reviews WHERE business_name NOT IN {_NAMES}", "named_reviews")(
    lambda t: joins.by_names(t.named_reviews, t.businesses.filter("city = 'NATION_1'"), anti=True))

_TOP = f"""SELECT r.* FROM (SELECT *, row_number() OVER (PARTITION BY business_id {NEWEST}) AS rn FROM reviews) AS r
WHERE rn <= 20 AND business_id IN (SELECT source_id FROM (SELECT source_id FROM businesses WHERE {{c}} ORDER BY rating DESC NULLS LAST, source_id LIMIT 50) AS b)"""
query("jn_top_reviews", R, _TOP.format(c="TRUE"), "businesses reviews")(
    lambda t: joins.top_business_reviews(t.businesses, t.reviews, 50, 20, ties=ALL_TIES))
_OF_KIND = "regexp_matches(category, 'Restaurant', 'i') AND (regexp_matches(city, 'NATION_', 'i') OR regexp_matches(address, 'NATION_', 'i'))"
_ALL_OF_KIND = f"SELECT * FROM reviews WHERE business_id IN (SELECT source_id FROM businesses WHERE {_OF_KIND})"
query("get_reviews", R, _ALL_OF_KIND, "businesses reviews")(
    lambda t: joins.get_reviews(t.businesses, t.reviews, "Restaurant", "NATION_", ties=ALL_TIES))
query("get_reviews_limited", R, f"{_ALL_OF_KIND} {NEWEST} LIMIT 250", "businesses reviews")(
    lambda t: joins.get_reviews(t.businesses, t.reviews, "Restaurant", "NATION_", 250, ties=ALL_TIES))
query("get_reviews_by_city", R, f"SELECT * FROM named_reviews WHERE regexp_matches(business_city, 'NATION_1', 'i') {NEWEST} LIMIT 1000", "named_reviews")(
    lambda t: joins.get_reviews(t.businesses, t.named_reviews, city="NATION_1", limit=1000, ties=ALL_TIES))

for _name, _pairs, _match in (("jn_competitors", CONTAINS, "contains"), ("jn_competitors_equal", EQUAL, "equal")):
    query(_name, "business_id source_id name rating:d review_count:i", f", {_pairs} SELECT * FROM pairs WHERE rn <= 20", "businesses")(
        lambda t, m=_match: joins.competitors(t.businesses, match=m).select("business_id", F.explode("competitors").alias("c")).select(
            "business_id", "c.source_id", "c.name", "c.rating", "c.review_count"))


# each supplier asks by patterns: alternatives, anchors, single signs, plain names
_REQUESTS = [
    "source_id AS request_id", "name",
    "CASE price_level WHEN 0 THEN '^rest|bar$' WHEN 1 THEN 'caf.' WHEN 2 THEN '^(fit|ser)' WHEN 3 THEN 'nothing' ELSE category END AS category_pattern",
    "CASE WHEN review_count % 3 = 0 THEN '^nation_[0-9]$' WHEN review_count % 3 = 1 THEN 'NATION_1' ELSE city END AS city_pattern",
]
query("jn_competitors_pattern", "request_id source_id name rating:d review_count:i", f"""
, requests AS (SELECT {', '.join(_REQUESTS)} FROM businesses),
pairs AS (SELECT r.request_id, b.source_id, b.name, b.rating, b.review_count,
  row_number() OVER (PARTITION BY r.request_id ORDER BY coalesce(b.rating, 0) DESC, b.source_id) AS rn
 FROM requests r JOIN businesses b ON regexp_matches(b.category, r.category_pattern, 'i') AND regexp_matches(b.city, r.city_pattern, 'i') AND b.name <> r.name)
SELECT * FROM pairs WHERE rn <= 20""", "businesses")(
    lambda t: joins.competitors_by_pattern(t.businesses.selectExpr(*_REQUESTS), t.businesses).select("request_id", F.explode("competitors").alias("c")).select(
        "request_id", "c.source_id", "c.name", "c.rating", "c.review_count"))


def _type_sql(mapping, fallbacks, default) -> str:
    known = quoted(mapping)
    first = f"list_filter(types, lambda x: list_contains([{known}], x))[1]"
    cases = " ".join(f"WHEN '{name}' THEN '{cat}/{'+'.join(sub)}'" for name, (cat, sub) in mapping.items())
    rest = " ".join(f"WHEN list_has_any(types, [{quoted(group)}]) THEN '{cat}/{'+'.join(sub)}'" for group, (cat, sub) in fallbacks)
    tail = f"'{default[0]}/{'+'.join(default[1])}'"
    return f"SELECT part, coalesce(CASE {first} {cases} END, CASE {rest} ELSE {tail} END) AS category FROM typed"


# each part as a place with two or three types, known and unknown
_TYPES = ("['point_of_interest', CASE p_size % 5 WHEN 0 THEN 'cafe' WHEN 1 THEN 'meal_takeaway' WHEN 2 THEN 'shopping' WHEN 3 THEN 'spa' ELSE 'park' END, "
          "CASE p_partkey % 4 WHEN 0 THEN 'food' WHEN 1 THEN 'gym' WHEN 2 THEN 'shopping_mall' ELSE 'establishment' END]")


def _typed(t: Tables):
    return t.raw("part").selectExpr("p_partkey AS part", f"array({_TYPES[1:-1]}) AS types")


def _type_query(name: str, *args) -> None:
    query(name, "part:i category", f"WITH typed AS (SELECT p_partkey AS part, {_TYPES} AS types FROM part) {_type_sql(*args)}")(
        lambda t: _typed(t).select("part", joins.type_category(F.col("types"), *args).alias("k")).select(
            "part", F.concat_ws("/", "k.category", F.array_join("k.subcategory", "+")).alias("category")))


from streetlens.constants import (  # noqa: E402
    LEGACY_PLACE_TYPE_DEFAULT, LEGACY_PLACE_TYPE_FALLBACKS, PLACE_TYPE_DEFAULT, PLACE_TYPE_FALLBACKS,
)

_type_query("jn_type_category", PLACE_TYPES, PLACE_TYPE_FALLBACKS, PLACE_TYPE_DEFAULT)
_type_query("jn_type_category_legacy", LEGACY_PLACE_TYPES, LEGACY_PLACE_TYPE_FALLBACKS, LEGACY_PLACE_TYPE_DEFAULT)

# a city query typed by each customer
CITY_QUERY = ("CASE c_custkey % 8 WHEN 0 THEN 'New York, NY, USA' WHEN 1 THEN 'chicago, usa' WHEN 2 THEN ' Dallas' WHEN 3 THEN 'San Jose, US' "
              "WHEN 4 THEN 'Paris, France' WHEN 5 THEN 'NYC' WHEN 6 THEN c_mktsegment ELSE 'Salt Lake City, UT' END")


def _queries(t: Tables):
    return t.raw("customer").selectExpr("c_custkey AS customer", f"{CITY_QUERY} AS city_query")


def _values(rows) -> str:
    return "(VALUES " + ", ".join(f"({i}, {quoted([k])}, {lat}, {lng}, {quoted([label])})" for i, (k, lat, lng, label) in enumerate(rows)) + ") AS g(pos, key, lat, lng, formatted_address)"


CLEAN_CITY = "trim(split_part(regexp_replace(trim(lower(city_query)), '(, usa|, us|, canada|, uk|, england|, france|, germany|, japan|, australia)$', ''), ',', 1))"
query("jn_gazetteer", "customer:i clean_city lat:d lng:d formatted_address", f"""
WITH q AS (SELECT c_custkey AS customer, {CITY_QUERY} AS city_query FROM customer)
SELECT customer, {CLEAN_CITY} AS clean_city, lat, lng, formatted_address FROM q LEFT JOIN {_values(GAZETTEER)} ON key = {CLEAN_CITY}""")(
    lambda t: joins.geocode(_queries(t), "city_query"))
query("jn_gazetteer_contains", "customer:i key lat:d lng:d", f"""
WITH q AS (SELECT c_custkey AS customer, {CITY_QUERY} AS city_query FROM customer),
m AS (SELECT customer, key, lat, lng, row_number() OVER (PARTITION BY customer ORDER BY pos) AS rn FROM q JOIN {_values(LEGACY_GAZETTEER)}
 ON contains(lower(city_query), key) OR contains(key, lower(city_query)))
SELECT customer, key, lat, lng FROM q LEFT JOIN (SELECT * FROM m WHERE rn = 1) AS f USING (customer)""")(
    lambda t: _queries(t).select("customer", joins.geocode_contains(F.col("city_query")).alias("g")).select("customer", "g.key", "g.lat", "g.lng"))

_DISTANCE = """2 * 6378100 * asin(sqrt(least(1.0, pow(sin(radians(latitude - 26.5) / 2), 2)
 + cos(radians(latitude)) * cos(radians(26.5)) * pow(sin(radians(longitude + 118) / 2), 2))))"""
query("jn_near", "source_id name distance_m:d", f"SELECT source_id, name, {_DISTANCE} AS distance_m FROM businesses WHERE {_DISTANCE} <= 300000", "businesses")(
    lambda t: joins.near(t.businesses, -118.0, 26.5, 300_000))
# each customer as a point; some stand beyond the ends of the map
_POINTS = [
    "c_custkey AS point_id",
    "CASE WHEN c_custkey % 50 = 49 THEN NULL ELSE CAST(-121 + (c_custkey * 29) % 5300 / 100.0 AS DOUBLE) END AS longitude",
    "CAST(24 + (c_custkey * 7) % 2700 / 100.0 AS DOUBLE) AS latitude",
]
_BETWEEN = """2 * 6378100 * asin(sqrt(least(1.0, pow(sin(radians(b.latitude - p.latitude) / 2), 2)
 + cos(radians(b.latitude)) * cos(radians(p.latitude)) * pow(sin(radians(b.longitude - p.longitude) / 2), 2))))"""
_PAIRS = f", p AS (SELECT {', '.join(_POINTS)} FROM customer), d AS (SELECT point_id, source_id, {_BETWEEN} AS distance_m FROM p, businesses b)"


def _near_pairs(t: Tables, distance: float, k: int | None):
    found = spatial.near_pairs(t.raw("customer").selectExpr(*_POINTS), t.businesses, distance, k)
    return found.select("point.point_id", "place.source_id", "distance_m")


query("jn_near_pairs", "point_id:i source_id distance_m:d", _PAIRS + " SELECT * FROM d WHERE distance_m <= 40000", "businesses")(
    lambda t: _near_pairs(t, 40_000, None))
query("jn_near_pairs_nearest", "point_id:i source_id distance_m:d", _PAIRS + """ SELECT * FROM d WHERE distance_m <= 300000
QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY round(distance_m, 6), source_id) <= 5""", "businesses")(
    lambda t: _near_pairs(t, 300_000, 5))
query("jn_nest_reviews", "source_id reviews_fetched:i avg_sentiment:d positive:i neutral:i negative:i newest:l", f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY business_id {NEWEST}) AS rn FROM reviews)
SELECT source_id, count(business_id) AS reviews_fetched, coalesce(avg(sentiment_score), 0) AS avg_sentiment, count(*) FILTER (WHERE sentiment_label = 'positive') AS positive,
 count(*) FILTER (WHERE sentiment_label = 'neutral') AS neutral, count(*) FILTER (WHERE sentiment_label = 'negative') AS negative, coalesce(list(concat(source_review_id, '/', seq, '/', r.rating) ORDER BY rn) FILTER (WHERE rn <= 20), []) AS newest
FROM more_businesses LEFT JOIN r ON business_id = source_id GROUP BY 1""", "more_businesses reviews")(
    lambda t: joins.nest_reviews(t.more_businesses.drop("source"), t.reviews, 20, ALL_TIES).withColumn(
        "newest", F.transform("reviews", lambda r: F.concat(r["source_review_id"], F.lit("/"), r["seq"], F.lit("/"), r["rating"]))))
query("jn_denormalise", "source_review_id seq:i business_id business_name business_category business_city", "SELECT * FROM named_reviews", "named_reviews")(
    lambda t: t.named_reviews)
_KEYWORDS = "SELECT keyword AS text FROM (SELECT unnest(keywords) AS keyword FROM scored) AS k GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 100"
query("jn_keyword_review", "text count:i", f", k AS ({_KEYWORDS}) SELECT text, (SELECT count(*) FROM scored WHERE contains(lower(review_text), text)) AS count FROM k", "scored")(
    lambda t: joins.keyword_review_counts(aggregates.top_keywords(t.scored, 100).select(F.col("keyword").alias("text")), t.texts))
# every different keyword of the texts, far too many for an array
query("jn_keyword_review_many", "text count:i", """, k AS (SELECT DISTINCT unnest(keywords) AS text FROM scored)
SELECT text, (SELECT count(*) FROM scored WHERE contains(lower(review_text), text)) AS count FROM k""", "scored")(
    lambda t: joins.keyword_review_counts(stage_table(exploded(t.scored, "keywords", "text").distinct(), "all-keywords"), t.texts))
query("jn_pair_compare", "first_id second_id first_name second_name first_rating:d second_rating:d first_review_count:i second_review_count:i first_price_level:i second_price_level:i", """
, best AS (SELECT category, source_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY rating DESC NULLS LAST, source_id) AS rn FROM businesses) AS r WHERE rn = 1)
SELECT a.source_id AS first_id, c.source_id AS second_id, a.name AS first_name, c.name AS second_name, a.rating AS first_rating, c.rating AS second_rating,
 a.review_count AS first_review_count, c.review_count AS second_review_count, a.price_level AS first_price_level, c.price_level AS second_price_level
FROM businesses a JOIN best ON best.category = a.category JOIN businesses c ON c.source_id = best.source_id""", "businesses")(
    lambda t: joins.pair_compare(t.businesses, t.businesses.select(F.col("source_id").alias("first_id"), "category").join(
        windows.top_n_per_group(t.businesses, ["category"], [F.col("rating").desc(), F.col("source_id").asc()], 1).select(
            "category", F.col("source_id").alias("second_id")), "category").select("first_id", "second_id")))

# -- windows ------------------------------------------------------------------------------------

ANOMALIES = """
, r AS (SELECT *, count(*) OVER (PARTITION BY business_id) AS c FROM reviews),
m AS (SELECT business_id, strftime(review_date, '%Y-%m') AS month, avg(rating) AS current_rating FROM r WHERE c >= 10
 AND rating IS NOT NULL AND rating <> 0 AND review_date IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3),
l AS (SELECT *, lag(current_rating) OVER (PARTITION BY business_id ORDER BY month) AS previous_rating FROM m),
anomalies AS (SELECT *, current_rating - previous_rating AS rating_change, CASE WHEN current_rating > previous_rating THEN 'increase' ELSE 'decrease' END AS type,
 CASE WHEN abs(current_rating - previous_rating) >= 1.0 THEN 'high' ELSE 'medium' END AS severity FROM l WHERE abs(current_rating - previous_rating) >= 0.5)"""
query("win_rating_anomalies", "business_id month previous_rating:d current_rating:d rating_change:d type severity", ANOMALIES + " SELECT * FROM anomalies", "reviews")(
    lambda t: windows.rating_anomalies(t.reviews, ties=TIES))
query("win_anomaly_summary", "total_anomalies:i businesses_affected:i", ANOMALIES + " SELECT count(*) AS total_anomalies, count(DISTINCT business_id) AS businesses_affected FROM anomalies", "reviews")(
    lambda t: windows.anomaly_summary(windows.rating_anomalies(t.reviews, ties=TIES)))
query("win_latest_reviews", R, f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY business_id {NEWEST}) AS rn FROM reviews) AS r WHERE rn <= 100", "reviews")(
    lambda t: windows.latest_reviews(t.reviews, 100, ALL_TIES))
query("win_top_per_category", "name category rating:d review_count:i", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY rating DESC, source_id) AS rn FROM businesses WHERE category IS NOT NULL AND rating IS NOT NULL) AS r
WHERE rn = 1""", "businesses")(lambda t: windows.top_per_category(t.businesses))
_RANKED = """SELECT source_id, category, coalesce(rating, 0) AS rating, rank() OVER w AS rating_rank, count(*) OVER (PARTITION BY category) AS total_businesses, {p} AS percentile
FROM businesses WINDOW w AS (PARTITION BY category ORDER BY coalesce(rating, 0))"""
_RANK_SPEC = "source_id category rating:d rating_rank:i total_businesses:i percentile:d"
query("rnk_percentile", _RANK_SPEC, _RANKED.format(p="(count(*) OVER (PARTITION BY category) - rank() OVER w) * 100.0 / count(*) OVER (PARTITION BY category)"), "businesses")(
    lambda t: windows.category_percentiles(t.businesses))
query("rnk_percentile_corrected", _RANK_SPEC, _RANKED.format(p="percent_rank() OVER w * 100"), "businesses")(
    lambda t: windows.category_percentiles(t.businesses, "percent_rank"))
query("win_dedupe_latest", R, f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_review_id, source {NEWEST}) AS rn FROM reviews) AS r WHERE rn = 1", "reviews")(
    lambda t: windows.latest_per_key(t.reviews, ["source_review_id", "source"], windows.newest_first(*ALL_TIES)))

# words and phrases of one review, most frequent first, then by first position
_TOP_WORDS = f"""
SELECT t.review_id, coalesce(list(word ORDER BY rn) FILTER (WHERE rn <= 10), []) AS keywords FROM texts t LEFT JOIN (
 SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY n DESC, p) AS rn FROM (SELECT review_id, word, count(*) AS n, min(pos) AS p FROM words
  WHERE length(word) > 2 AND word NOT IN ({quoted(STOP_WORDS)}) GROUP BY 1, 2) AS c) AS k USING (review_id) GROUP BY 1"""
_TOP_PHRASES = f"""
, pairs AS (SELECT a.review_id, a.word || ' ' || b.word AS phrase, a.pos FROM words a JOIN words b ON a.review_id = b.review_id AND b.pos = a.pos + 1
 WHERE a.word NOT IN ({quoted(STOP_WORDS)}) AND b.word NOT IN ({quoted(STOP_WORDS)}))
SELECT t.review_id, coalesce(list(phrase ORDER BY rn) FILTER (WHERE rn <= 5), []) AS phrases FROM texts t LEFT JOIN (
 SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY n DESC, p) AS rn FROM (SELECT review_id, phrase, count(*) AS n, min(pos) AS p FROM pairs
  WHERE length(phrase) > 5 GROUP BY 1, 2) AS c) AS k USING (review_id) GROUP BY 1"""


for _name in ("win_keywords_per_review", "txt_keywords"):
    query(_name, "review_id:i keywords:l", _TOP_WORDS, "texts words")(
        lambda t: t.texts.select("review_id", text.keywords(F.col("review_text"), 10, STOP_WORDS).alias("keywords")))
for _name in ("win_phrases_per_review", "txt_phrases"):
    query(_name, "review_id:i phrases:l", _TOP_PHRASES, "texts words")(
        lambda t: t.texts.select("review_id", text.phrases(F.col("review_text"), 5, STOP_WORDS).alias("phrases")))
