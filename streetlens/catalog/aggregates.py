"""Queries of the aggregations and rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from streetlens.catalog.base import Tables, query
from streetlens.catalog.filters import CONTAINS
from streetlens.catalog.sql import STOP_WORDS, quoted
from streetlens.operators import aggregates as A
from streetlens.operators import joins, rules, tfidf

TIES = ("source_review_id", "seq")
TEXT_AS_OF = dt.datetime(2024, 11, 30)

query("agg_business_analytics", "business_id avg_rating:d total_reviews:i avg_sentiment:d latest_review:t earliest_review:t", """
SELECT business_id, avg(rating) AS avg_rating, count(*) AS total_reviews, avg(sentiment_score) AS avg_sentiment,
 max(review_date) AS latest_review, min(review_date) AS earliest_review FROM reviews GROUP BY 1""", "reviews")(
    lambda t: A.business_analytics(t.reviews))

CATEGORY_SEMI = "r.business_id IN (SELECT source_id FROM businesses WHERE regexp_matches(category, 'Restaurant', 'i'))"
query("agg_category_analytics", "avg_rating:d total_reviews:i avg_sentiment:d", f"""
SELECT avg(rating) AS avg_rating, count(*) AS total_reviews, avg(sentiment_score) AS avg_sentiment FROM reviews r WHERE {CATEGORY_SEMI} HAVING count(*) > 0""", "businesses reviews")(
    lambda t: A.category_analytics(t.businesses, t.reviews, "Restaurant"))

query("agg_business_profile", "business_id avg_rating:d total_reviews:i fives:i months:i top_word top_n:i", """
, kw AS (SELECT business_id, keyword, count(*) AS n FROM (SELECT business_id, unnest(keywords) AS keyword FROM scored) AS u GROUP BY 1, 2),
best AS (SELECT business_id, keyword, n, row_number() OVER (PARTITION BY business_id ORDER BY n DESC, keyword) AS rn FROM kw)
SELECT s.business_id, avg(rating) AS avg_rating, count(*) AS total_reviews, nullif(count(*) FILTER (WHERE rating = 5), 0) AS fives,
 count(DISTINCT strftime(review_date, '%Y-%m')) AS months, any_value(b.keyword) AS top_word, any_value(b.n) AS top_n
FROM scored s LEFT JOIN best b ON b.business_id = s.business_id AND b.rn = 1 GROUP BY 1""", "scored")(
    lambda t: A.business_profile(t.scored.withColumn("source_review_id", F.col("review_id"))).select(
        "business_id", "avg_rating", "total_reviews", F.try_element_at("rating_distribution", F.lit(5)).alias("fives"),
        F.size("sentiment_trend").alias("months"),
        F.get("top_keywords", F.lit(0))["keyword"].alias("top_word"), F.get("top_keywords", F.lit(0))["n"].alias("top_n")))

query("agg_trending_words", "word count:i", """
SELECT word, count(*) AS count FROM (SELECT unnest(string_split(review_text, ' ')) AS word FROM texts WHERE review_date >= DATE '2024-10-31') AS w
WHERE word NOT IN ('', 'the', 'and', 'or', 'but', 'a', 'an') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""", "texts")(
    lambda t: A.trending_words(t.texts, TEXT_AS_OF))

# -- TF-IDF in SQL ---------------------------------------------------------------------------

TFIDF = """
, src AS (SELECT * FROM texts WHERE review_text <> '' AND {recent}),
toks AS (SELECT c.review_id, word, row_number() OVER (PARTITION BY c.review_id ORDER BY pos) AS p FROM words c JOIN src USING (review_id)
  WHERE length(word) >= 2 AND word NOT IN ({stops})),
grams AS (SELECT review_id, word AS term FROM toks UNION ALL
  SELECT a.review_id, a.word || ' ' || b.word FROM toks a JOIN toks b ON a.review_id = b.review_id AND b.p = a.p + 1),
tf AS (SELECT review_id, term, count(*) AS tf FROM grams GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM src),
kept AS (SELECT term, ln((1 + max(n.n)) / (1.0 + count(*))) + 1 AS idf FROM tf, n GROUP BY term
  HAVING count(*) >= 2 AND count(*) <= 0.8 * max(n.n) ORDER BY sum(tf) DESC, term LIMIT 500),
w AS (SELECT review_id, tf.term, tf * idf AS w FROM tf JOIN kept ON tf.term = kept.term),
l AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY review_id)) AS norm FROM w),
ranked AS (SELECT term AS text, sum(w / norm) / max(n.n) AS weight FROM l, n GROUP BY term ORDER BY round(sum(w / norm) / max(n.n), 12) DESC, term LIMIT {k})"""


def tfidf_sql(k: int, recent: str = "TRUE") -> str:
    return TFIDF.format(k=k, recent=recent, stops=quoted(STOP_WORDS))


# the vocabulary that this SQL has; the operators take all terms unless told otherwise
SQL_TERMS = 500


def all_terms(body: str) -> str:
    return body.replace(f" LIMIT {SQL_TERMS})", ")")


_CLOUD = "SELECT text, weight, (SELECT count(*) FROM src WHERE contains(lower(review_text), text)) AS count"
query("tfidf_keywords", "text weight:d", tfidf_sql(50) + " SELECT * FROM ranked", "texts words")(
    lambda t: tfidf.tfidf_keywords(t.texts, 50, stop_words=STOP_WORDS, max_terms=SQL_TERMS))
query("agg_keyword_cloud", "text weight:d count:i", tfidf_sql(100) + f" {_CLOUD} FROM ranked", "texts words")(
    lambda t: tfidf.keyword_cloud(t.texts, 100, stop_words=STOP_WORDS, max_terms=SQL_TERMS))
TRENDING = tfidf_sql(100, "review_date >= DATE '2024-11-23'")
TRENDING_RESULT = TRENDING + f" {_CLOUD}, TIMESTAMP '2024-11-30' AS generated_at, 7 AS period_days FROM ranked"
query("agg_trending_keywords", "text weight:d count:i generated_at:t period_days:i", TRENDING_RESULT, "texts words")(
    lambda t: A.trending_keywords(t.texts, TEXT_AS_OF, 7, stop_words=STOP_WORDS, max_terms=SQL_TERMS))
query("tfidf_keywords_all_terms", "text weight:d", all_terms(tfidf_sql(50) + " SELECT * FROM ranked"), "texts words")(
    lambda t: tfidf.tfidf_keywords(t.texts, 50, stop_words=STOP_WORDS))
query("agg_keyword_cloud_all_terms", "text weight:d count:i", all_terms(tfidf_sql(100) + f" {_CLOUD} FROM ranked"), "texts words")(
    lambda t: tfidf.keyword_cloud(t.texts, 100, stop_words=STOP_WORDS))
query("agg_trending_keywords_all_terms", "text weight:d count:i generated_at:t period_days:i", all_terms(TRENDING_RESULT), "texts words")(
    lambda t: A.trending_keywords(t.texts, TEXT_AS_OF, 7, stop_words=STOP_WORDS))

# -- businesses ----------------------------------------------------------------------------------

query("agg_overall_rating", "avg_rating:d insight", """
SELECT avg(rating) AS avg_rating, CASE WHEN avg(rating) >= 4.0 THEN 'good' WHEN avg(rating) >= 3.5 THEN 'improving' ELSE 'attention' END AS insight
FROM businesses HAVING count(*) > 0""", "businesses")(lambda t: A.overall_rating(t.businesses))
query("agg_category_count", "categories:i", "SELECT count(DISTINCT category) AS categories FROM businesses WHERE category <> ''", "businesses")(
    lambda t: A.category_count(t.businesses))
query("agg_reviews_per_business", "businesses:i reviews:i reviews_per_business:d level", """
SELECT *, CASE WHEN reviews_per_business >= 100 THEN 'high' WHEN reviews_per_business >= 20 THEN 'medium' ELSE 'low' END AS level FROM (
SELECT (SELECT count(*) FROM businesses) AS businesses, (SELECT count(*) FROM reviews) AS reviews,
 (SELECT count(*) FROM reviews) / (SELECT count(*) FROM businesses) AS reviews_per_business) AS x""", "businesses reviews")(
    lambda t: A.reviews_per_business(t.businesses, t.reviews))
query("agg_opportunity_pct", "opportunity_pct:d", "SELECT count(*) FILTER (WHERE rating >= 4.0 AND review_count < 50) * 100.0 / count(*) AS opportunity_pct FROM businesses", "businesses")(
    lambda t: A.opportunity_pct(t.businesses))
query("agg_top_metrics", "businesses:i avg_rating:d total_reviews:i categories:i", """
SELECT count(*) AS businesses, avg(nullif(rating, 0)) AS avg_rating, sum(review_count) AS total_reviews, count(DISTINCT category) AS categories FROM businesses""", "businesses")(
    lambda t: A.top_metrics(t.businesses))
query("agg_rating_histogram", "rating:d count:i", "SELECT rating, count(*) AS count FROM businesses WHERE rating IS NOT NULL GROUP BY 1", "businesses")(
    lambda t: A.rating_histogram(t.businesses))
query("agg_category_top10", "category count:i", "SELECT category, count(*) AS count FROM businesses WHERE category IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "businesses")(
    lambda t: A.category_top(t.businesses))
SEGMENT = """CASE WHEN rating >= 4.5 AND review_count >= 50 THEN 'Market Leaders' WHEN rating >= 4.0 AND review_count < 50 THEN 'Rising Stars'
 WHEN rating >= 3.5 AND review_count >= 50 THEN 'Established Players' WHEN rating < 4.0 THEN 'Growth Opportunities' ELSE 'New Entries' END"""
query("agg_segments", "segment count:i", f"SELECT {SEGMENT} AS segment, count(*) AS count FROM businesses GROUP BY 1", "businesses")(
    lambda t: A.segments(t.businesses))
query("agg_market_gaps", "category count:i avg_rating:d", "SELECT category, count(*) AS count, avg(rating) AS avg_rating FROM businesses WHERE category IS NOT NULL GROUP BY 1 ORDER BY 2, 1 LIMIT 10", "businesses")(
    lambda t: A.market_gaps(t.businesses))
query("agg_market_concentration", "category share_pct:d", "SELECT category, count(*) * 100.0 / (SELECT count(*) FROM businesses) AS share_pct FROM businesses GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1", "businesses")(
    lambda t: A.market_concentration(t.businesses))
query("agg_quality_share", "quality_pct:d", "SELECT count(*) FILTER (WHERE rating >= 4.0) * 100.0 / count(*) AS quality_pct FROM businesses", "businesses")(
    lambda t: A.quality_share(t.businesses))
query("agg_high_engagement", "high_engagement:i", "SELECT count(*) AS high_engagement FROM businesses WHERE review_count >= 100", "businesses")(
    lambda t: A.high_engagement(t.businesses))
query("agg_hidden_gems", "hidden_gems:i", "SELECT count(*) AS hidden_gems FROM businesses WHERE rating >= 4.5 AND review_count < 20", "businesses")(
    lambda t: A.hidden_gems(t.businesses))
query("agg_map_extent", "points:i min_lat:d max_lat:d min_lon:d max_lon:d center_lat:d center_lon:d south:d west:d north:d east:d", """
SELECT count(*) AS points, min(latitude) AS min_lat, max(latitude) AS max_lat, min(longitude) AS min_lon, max(longitude) AS max_lon,
 (min(latitude) + max(latitude)) / 2 AS center_lat, (min(longitude) + max(longitude)) / 2 AS center_lon,
 min(latitude) - (max(latitude) - min(latitude)) * 0.1 AS south, min(longitude) - (max(longitude) - min(longitude)) * 0.1 AS west,
 max(latitude) + (max(latitude) - min(latitude)) * 0.1 AS north, max(longitude) + (max(longitude) - min(longitude)) * 0.1 AS east
FROM businesses WHERE latitude IS NOT NULL AND longitude IS NOT NULL""", "businesses")(lambda t: A.map_extent(t.businesses))

# -- reviews ---------------------------------------------------------------------------------------

query("agg_sentiment_distribution", "sentiment_label count:i positive_pct:d", """
SELECT sentiment_label, count(*) AS count, (SELECT count(*) FILTER (WHERE sentiment_label = 'positive') * 100.0 / count(*) FROM reviews) AS positive_pct FROM reviews GROUP BY 1""", "reviews")(
    lambda t: A.sentiment_distribution(t.reviews))
query("agg_sentiment_metrics", "avg_sentiment:d positive:i negative:i neutral:i total:i", """
SELECT avg(sentiment_score) AS avg_sentiment, count(*) FILTER (WHERE sentiment_score > 0.05) AS positive, count(*) FILTER (WHERE sentiment_score < -0.05) AS negative,
 count(*) FILTER (WHERE sentiment_score BETWEEN -0.05 AND 0.05) AS neutral, count(*) AS total FROM reviews""", "reviews")(
    lambda t: A.sentiment_metrics(t.reviews))
_LABELS = "count(*) FILTER (WHERE sentiment_label = 'positive') AS positive, count(*) FILTER (WHERE sentiment_label = 'negative') AS negative, count(*) FILTER (WHERE sentiment_label = 'neutral') AS neutral"
query("agg_monthly_sentiment_pivot", "month positive:i negative:i neutral:i total:i",
      f"SELECT strftime(review_date, '%Y-%m') AS month, {_LABELS}, count(*) AS total FROM reviews GROUP BY 1", "reviews")(
    lambda t: A.monthly_sentiment(t.reviews))
query("agg_monthly_sentiment_by_business", "business_id month positive:i negative:i neutral:i total:i",
      f"SELECT business_id, strftime(review_date, '%Y-%m') AS month, {_LABELS}, count(*) AS total FROM reviews GROUP BY 1, 2", "reviews")(
    lambda t: A.monthly_sentiment(t.reviews, ["business_id"]))
query("agg_business_stats", "business_name avg_rating:d avg_sentiment:d business_category", """
SELECT business_name, avg(rating) AS avg_rating, avg(sentiment_score) AS avg_sentiment, min(business_category) AS business_category FROM named_reviews GROUP BY 1""", "named_reviews")(
    lambda t: A.business_stats(t.named_reviews))
query("agg_top_business", "business_name avg_rating:d", "SELECT business_name, avg(rating) AS avg_rating FROM named_reviews GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1", "named_reviews")(
    lambda t: A.top_business(A.business_stats(t.named_reviews)))
query("agg_monthly_rating", "month avg_rating:d", "SELECT strftime(review_date, '%Y-%m') AS month, avg(rating) AS avg_rating FROM reviews GROUP BY 1", "reviews")(
    lambda t: A.monthly_rating(t.reviews))
query("agg_monthly_volume", "month reviews:i", "SELECT strftime(review_date, '%Y-%m') AS month, count(*) AS reviews FROM reviews GROUP BY 1", "reviews")(
    lambda t: A.monthly_volume(t.reviews))
_MONDAY = "CAST(date_trunc('week', review_date) AS DATE)"
for _name, _period, _label in (
    ("agg_sentiment_trend", "month", "strftime(review_date, '%Y-%m')"),
    ("agg_sentiment_trend_week", "week", f"strftime({_MONDAY}, '%Y-%m-%d') || '/' || strftime({_MONDAY} + 6, '%Y-%m-%d')"),
    ("agg_sentiment_trend_day", "day", "strftime(review_date, '%Y-%m-%d')"),
):
    query(_name, "period avg_sentiment:d review_count:i avg_rating:d", f"""
SELECT {_label} AS period, avg(sentiment_score) AS avg_sentiment, count(sentiment_score) AS review_count, avg(rating) AS avg_rating FROM reviews GROUP BY 1""", "reviews")(
        lambda t, p=_period: A.sentiment_trend(t.reviews, p))

_BUCKETS = """, rows AS (SELECT unnest(keywords) AS keyword, sentiment_score, CASE WHEN sentiment_label = 'positive' OR rating >= 4 THEN 'positive'
 WHEN sentiment_label = 'negative' OR rating <= 2 THEN 'negative' ELSE 'neutral' END AS bucket FROM scored)"""
query("agg_keyword_buckets", "bucket keyword count:i", _BUCKETS + """
SELECT bucket, keyword, count FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY count DESC, keyword) AS rn FROM (
 SELECT bucket, keyword, count(*) AS count FROM rows GROUP BY 1, 2 UNION ALL SELECT 'all', keyword, count(*) FROM rows GROUP BY 2) AS c) AS r WHERE rn <= 20""", "scored")(
    lambda t: A.keyword_buckets(t.scored))
query("agg_keyword_terms", "bucket terms:i", _BUCKETS + " SELECT bucket, count(DISTINCT keyword) AS terms FROM rows GROUP BY 1", "scored")(
    lambda t: A.keyword_terms(t.scored))
query("agg_keyword_tag", "keyword count:i tag", _BUCKETS + """
SELECT keyword, count(*) AS count, CASE WHEN bool_or(bucket = 'positive') THEN 'positive' WHEN bool_or(bucket = 'negative') THEN 'negative' ELSE 'neutral' END AS tag FROM rows GROUP BY 1""", "scored")(
    lambda t: A.keyword_tags(t.scored))
query("agg_keyword_sentiment", "side keyword avg_sentiment:d count:i", _BUCKETS + """
, m AS (SELECT keyword, avg(sentiment_score) AS avg_sentiment, count(*) AS count FROM rows GROUP BY 1 HAVING count(*) >= 3)
SELECT * FROM (SELECT 'most_positive' AS side, * FROM m ORDER BY round(avg_sentiment, 9) DESC, keyword LIMIT 10) AS a
UNION ALL SELECT * FROM (SELECT 'most_negative' AS side, * FROM m ORDER BY round(avg_sentiment, 9), keyword DESC LIMIT 10) AS b""", "scored")(
    lambda t: A.keyword_sentiment(t.scored))
query("agg_hourly_activity", "hour:i reviews:i hour_label open:b peak:b", """
, h AS (SELECT extract(hour FROM review_date) AS hour, count(*) AS reviews FROM clicks GROUP BY 1)
SELECT *, CASE WHEN hour = 0 THEN '12 AM' WHEN hour < 12 THEN hour || ' AM' WHEN hour = 12 THEN '12 PM' ELSE (hour - 12) || ' PM' END AS hour_label,
 hour BETWEEN 6 AND 22 AS open, hour = (SELECT hour FROM h ORDER BY reviews DESC, hour LIMIT 1) AS peak FROM h""", "clicks")(
    lambda t: A.hourly_activity(t.clicks))
query("agg_busiest_day", "day_no:i day reviews:i busiest:b", """
, d AS (SELECT isodow(review_date) - 1 AS day_no, count(*) AS reviews FROM clicks GROUP BY 1)
SELECT c.i AS day_no, list_extract(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'], CAST(c.i + 1 AS INT)) AS day,
 coalesce(reviews, 0) AS reviews, c.i = (SELECT day_no FROM d ORDER BY reviews DESC, day_no LIMIT 1) AS busiest FROM range(7) AS c(i) LEFT JOIN d ON d.day_no = c.i""", "clicks")(
    lambda t: A.weekday_activity(t.clicks))
query("agg_positive_pct", "business_id positive_pct:d reviews:i", "SELECT business_id, count(*) FILTER (WHERE sentiment_label = 'positive') * 100.0 / count(*) AS positive_pct, count(*) AS reviews FROM reviews GROUP BY 1", "reviews")(
    lambda t: A.positive_pct(t.reviews))
query("agg_positive_pct_recent", "business_id positive_pct:d reviews:i", """
SELECT business_id, count(*) FILTER (WHERE sentiment_label = 'positive') * 100.0 / count(*) AS positive_pct, count(*) AS reviews FROM (
 SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY review_date DESC, source_review_id DESC, seq DESC, sentiment_score DESC) AS rn FROM reviews) AS r WHERE rn <= 50 GROUP BY 1""", "reviews")(
    lambda t: A.positive_pct(t.reviews, 50, (*TIES, "sentiment_score")))
for _label in ("positive", "negative"):
    query("agg_label_words" if _label == "positive" else "agg_label_words_negative", "word count:i", f"""
SELECT word, count(*) AS count FROM (SELECT unnest(regexp_split_to_array(lower(review_text), '[ \\t\\n\\x{{0B}}\\f\\r]+')) AS word FROM scored WHERE sentiment_label = '{_label}') AS w
 WHERE length(word) > 3 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40""", "scored")(
        lambda t, l=_label: A.label_words(t.scored, l, k=40))
query("agg_label_distribution", "business_id positive:i neutral:i negative:i", f"SELECT business_id, {_LABELS} FROM reviews GROUP BY 1", "reviews")(
    lambda t: A.label_distribution(t.reviews))
query("agg_top_keywords", "keyword count:i frequency:d", """
, k AS (SELECT unnest(keywords) AS keyword FROM scored) SELECT keyword, count(*) AS count, count(*) / (SELECT count(*) FROM k) AS frequency FROM k GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""", "scored")(
    lambda t: A.top_keywords(t.scored))
query("agg_rating_distribution", "business_id rating_1:i rating_2:i rating_3:i rating_4:i rating_5:i",
      "SELECT business_id, " + ", ".join(f"count(*) FILTER (WHERE rating = {r}) AS rating_{r}" for r in range(1, 6)) + " FROM reviews GROUP BY 1", "reviews")(
    lambda t: A.rating_distribution(t.reviews))
query("agg_avg_sentiment_zero", "business_id avg_sentiment:d", """
SELECT source_id AS business_id, coalesce(avg(CASE WHEN r.business_id IS NOT NULL THEN coalesce(CASE WHEN seq % 4 <> 0 THEN sentiment_score END, 0) END), 0) AS avg_sentiment
FROM more_businesses LEFT JOIN reviews AS r ON r.business_id = source_id GROUP BY 1""", "more_businesses reviews")(
    lambda t: A.avg_sentiment_zero(t.more_businesses, t.reviews.withColumn(
        "sentiment_score", F.when(F.col("seq") % 4 != 0, F.col("sentiment_score")))))
query("agg_score_histogram", "bin:i count:i", """
SELECT greatest(0, least(19, floor((sentiment_score + 1) / 0.1 + 1e-9))) AS bin, count(*) AS count FROM reviews GROUP BY 1""", "reviews")(
    lambda t: A.score_histogram(t.reviews))

# -- competitors and overviews --------------------------------------------------------------------

query("agg_competitor_metrics", "business_id name rating:d review_count:i avg_sentiment:d category price_level:i market_rating:d market_review_count:i market_sentiment:d", """
, a AS (SELECT business_id, avg(sentiment_score) AS s FROM reviews GROUP BY 1),
c AS (SELECT source_id AS business_id, name, coalesce(rating, 0) AS rating, review_count, coalesce(s, 0) AS avg_sentiment, category, price_level FROM more_businesses LEFT JOIN a ON a.business_id = source_id)
SELECT *, (SELECT round(avg(rating), 2) FROM c) AS market_rating, (SELECT floor(avg(review_count)) FROM c) AS market_review_count, (SELECT round(avg(avg_sentiment), 3) FROM c) AS market_sentiment FROM c""", "more_businesses reviews")(
    lambda t: A.competitor_metrics(
        t.more_businesses, t.reviews,
        t.more_businesses.select(F.explode(F.array("source_id", F.concat(F.lit("unknown_"), "source_id"))).alias("business_id"))))

POSITION = f""", {CONTAINS},
position AS (SELECT business_id, coalesce(any_value(own_rating), 0) AS rating, any_value(own_reviews) AS review_count,
 avg(coalesce(rating, 0)) AS avg_competitor_rating, avg(review_count) AS avg_competitor_reviews,
 count(*) FILTER (WHERE coalesce(rating, 0) < coalesce(own_rating, 0)) + 1 AS rating_rank, count(*) + 1 AS total_businesses
 FROM pairs GROUP BY 1),
placed AS (SELECT *, (total_businesses - rating_rank) * 100.0 / total_businesses AS percentile, rating - avg_competitor_rating AS rating_diff,
 review_count - avg_competitor_reviews AS review_diff FROM position)"""
_POSITION_SPEC = "business_id rating:d review_count:i avg_competitor_rating:d avg_competitor_reviews:d rating_rank:i total_businesses:i percentile:d rating_diff:d review_diff:d"


def _position(t: Tables):
    return A.competitive_position(t.businesses, "contains")


query("agg_competitive_position", _POSITION_SPEC, POSITION + " SELECT * FROM placed", "businesses")(_position)
query("rule_competitive", "business_id rating_insight review_insight position_tier", POSITION + """
SELECT business_id, CASE WHEN rating_diff > 0 THEN 'rating_advantage' WHEN rating_diff = 0 THEN 'on_par' ELSE 'opportunity' END AS rating_insight,
 CASE WHEN review_diff > 0 THEN 'review_leader' WHEN review_diff = 0 THEN 'average_volume' ELSE 'growth_opportunity' END AS review_insight,
 CASE WHEN percentile >= 80 THEN 'top' WHEN percentile >= 60 THEN 'strong' ELSE 'room_to_grow' END AS position_tier FROM placed""", "businesses")(
    lambda t: rules.competitive(_position(t)))
query("agg_vs_category", "source_id category rating:d category_avg:d vs_category:d", """
SELECT b.source_id, b.category, b.rating, avg(o.rating) AS category_avg, CASE WHEN avg(o.rating) > 0 THEN coalesce(b.rating, 0) - avg(o.rating) ELSE 0 END AS vs_category
FROM businesses b JOIN businesses o ON contains(lower(o.category), lower(b.category)) GROUP BY 1, 2, 3""", "businesses")(
    lambda t: A.vs_category(t.businesses))
query("rule_improvement", "business_id kind title value:d", """
, s AS (SELECT business_id, count(*) FILTER (WHERE sentiment_label = 'positive') * 100.0 / count(*) AS good, count(*) FILTER (WHERE sentiment_label = 'negative') * 100.0 / count(*) AS bad FROM reviews GROUP BY 1),
j AS (SELECT business_id, good, bad, coalesce(rating, 0) AS rating, review_count FROM s JOIN businesses ON source_id = business_id)
SELECT business_id, 'success' AS kind, 'excellent_satisfaction' AS title, good AS value FROM j WHERE good >= 80
UNION ALL SELECT business_id, 'info', 'good_satisfaction', good FROM j WHERE good >= 60 AND good < 80
UNION ALL SELECT business_id, 'warning', 'satisfaction_needs_attention', bad FROM j WHERE good < 60
UNION ALL SELECT business_id, 'warning', 'rating_improvement_opportunity', rating FROM j WHERE rating < 4.0
UNION ALL SELECT business_id, 'success', 'excellent_rating', rating FROM j WHERE rating >= 4.5
UNION ALL SELECT business_id, 'info', 'increase_review_volume', review_count FROM j WHERE review_count < 50""", "businesses reviews")(
    lambda t: rules.improvement(t.businesses, t.reviews))
query("agg_source_counts", "source businesses:i reviews:i total:i", """
SELECT source, b.n AS businesses, coalesce(r.n, 0) AS reviews, b.n + coalesce(r.n, 0) AS total FROM (SELECT source, count(*) AS n FROM businesses GROUP BY 1) AS b
LEFT JOIN (SELECT source, count(*) AS n FROM reviews GROUP BY 1) AS r USING (source)""", "businesses reviews")(
    lambda t: A.source_counts(t.businesses, t.reviews))
query("agg_city_top10", "city count:i", "SELECT coalesce(CASE WHEN price_level <> 2 THEN city END, 'Unknown') AS city, count(*) AS count FROM businesses GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "businesses")(
    lambda t: A.city_top(t.businesses.withColumn("city", F.when(F.col("price_level") != 2, F.col("city")))))
query("agg_category_counts", "category count:i", "SELECT category, count(*) AS count FROM businesses GROUP BY 1", "businesses")(
    lambda t: A.category_top(t.businesses, None))
query("agg_table_counts", "collection rows:i", """
SELECT 'businesses' AS collection, count(*) AS rows FROM businesses UNION ALL SELECT 'reviews', count(*) FROM reviews UNION ALL SELECT 'events', count(*) FROM clicks""", "businesses reviews clicks")(
    lambda t: A.table_counts({"businesses": t.businesses, "reviews": t.reviews, "events": t.clicks}))
