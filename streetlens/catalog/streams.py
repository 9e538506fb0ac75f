"""Queries of the streaming forms and the composed jobs; each equals its batch form."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetlens import schemas
from streetlens.catalog import sql as S
from streetlens.catalog.aggregates import _LABELS, SQL_TERMS, TRENDING, TRENDING_RESULT, all_terms
from streetlens.catalog.base import Tables, query
from streetlens.catalog.functions import _COUNTS, _LABEL, _SUM, ENRICHED, WIDE_LEXICON
from streetlens.catalog.relations import _TOP_WORDS, ALL_TIES, ANOMALIES, NEWEST, TIES
from streetlens.catalog.storage import _PLACE_SQL, _old_anomalies, details_json, places_json
from streetlens.operators import windows
from streetlens.plans import jobs
from streetlens.streaming import streams


def _landed(t: Tables, name: str) -> DataFrame:
    # the pattern makes a stream of a table that is one file, and of one that is a folder
    return streams.read_stream(t.spark, f"{t.sf_dir}/{name}.parque[t]")


def _review_stream(t: Tables) -> DataFrame:
    return _landed(t, "lineitem").selectExpr(*S.REVIEW_COLUMNS)


_TEXT_STREAM = [c for c in S.TEXT_COLUMNS if "n_suppliers" not in c]

query("str_enrich_reviews", "review_id:i sentiment_score:d sentiment_label keywords:l phrases:l word_count:i character_count:i", ENRICHED, "texts words cleaned")(
    lambda t: streams.enrich_reviews(_landed(t, "documents").selectExpr(*_TEXT_STREAM), WIDE_LEXICON, S.STOP_WORDS))
query("str_business_analytics", "business_id avg_rating:d total_reviews:i avg_sentiment:d latest_review:t earliest_review:t", """
SELECT business_id, avg(rating) AS avg_rating, count(*) AS total_reviews, avg(sentiment_score) AS avg_sentiment,
 max(review_date) AS latest_review, min(review_date) AS earliest_review FROM reviews GROUP BY 1""", "reviews")(
    lambda t: streams.business_analytics(_review_stream(t)))
query("str_trending_keywords", "window_start:t keyword count:i", f"""
, k AS (SELECT review_id, unnest(keywords) AS keyword FROM ({_TOP_WORDS}) AS w),
panes AS (SELECT CAST(review_date AS TIMESTAMP) AS pane, keyword, count(*) AS count FROM k JOIN texts USING (review_id) GROUP BY 1, 2)
SELECT pane - i * INTERVAL 6 HOUR AS window_start, keyword, sum(count) AS count FROM panes, range(28) AS r(i) GROUP BY 1, 2""", "texts words")(
    lambda t: streams.trending_keywords(_landed(t, "documents").selectExpr(*_TEXT_STREAM), S.STOP_WORDS))
query("str_rating_anomalies", "business_id month previous_rating:d current_rating:d rating_change:d type severity", ANOMALIES + " SELECT * FROM anomalies", "reviews")(
    lambda t: streams.rating_anomalies(_review_stream(t)))
query("str_ingest_dedupe", "source_review_id source seq:i business_id rating:i sentiment_score:d review_date:t", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_review_id, source {NEWEST}) AS rn FROM reviews) AS r WHERE rn = 1""", "reviews")(
    lambda t: streams.ingest_dedupe(_review_stream(t), ["source_review_id", "source"], windows.newest_first(*ALL_TIES)))
query("str_monthly_sentiment", "month positive:i negative:i neutral:i total:i",
      f"SELECT strftime(review_date, '%Y-%m') AS month, {_LABELS}, count(*) AS total FROM reviews GROUP BY 1", "reviews")(
    lambda t: streams.monthly_sentiment(_review_stream(t)))

# -- jobs ---------------------------------------------------------------------------------------------

TEXT_AS_OF = dt.datetime(2024, 11, 30)


def _stored_texts(t: Tables) -> DataFrame:
    return t.texts.withColumns({
        "processed_at": F.when(F.col("review_id") % 4 == 0, F.lit(TEXT_AS_OF)),
        "review_date": F.col("review_date").cast("timestamp")})


def _full(t: Tables, max_terms: int | None = SQL_TERMS) -> dict[str, DataFrame]:
    return jobs.full_run(_stored_texts(t), t.more_businesses, TEXT_AS_OF, WIDE_LEXICON, S.STOP_WORDS, max_terms=max_terms)


query("job_full_pipeline", "processed_reviews:i updated_businesses:i trending_keywords:i", TRENDING + """
SELECT (SELECT count(*) FROM texts WHERE review_id % 4 <> 0) AS processed_reviews, (SELECT count(DISTINCT business_id) FROM texts) AS updated_businesses,
 (SELECT count(*) FROM ranked) AS trending_keywords""", "texts words")(
    lambda t: _full(t)["summary"])
# the scores of reviews processed before are not in the given table and stay null
query("job_full_pipeline_businesses", "source_id avg_rating:d total_reviews:i avg_sentiment:d latest_review:t analytics_updated:t", f"""
, scores AS (SELECT review_id, CASE WHEN review_text <> '' THEN s / sqrt(s * s + 15) END AS score FROM (SELECT review_id, {_SUM} AS s FROM cleaned) AS x JOIN texts USING (review_id))
SELECT source_id, avg(t.rating) AS avg_rating, nullif(count(t.review_id), 0) AS total_reviews, avg(CASE WHEN t.review_id % 4 <> 0 THEN score END) AS avg_sentiment,
 CAST(max(t.review_date) AS TIMESTAMP) AS latest_review, CASE WHEN count(t.review_id) > 0 THEN TIMESTAMP '2024-11-30' END AS analytics_updated
FROM more_businesses LEFT JOIN texts t ON t.business_id = source_id LEFT JOIN scores USING (review_id) GROUP BY 1""", "more_businesses texts cleaned")(
    lambda t: _full(t)["businesses"].select("source_id", "analytics.*", "analytics_updated"))
query("job_full_pipeline_trending", "text weight:d count:i generated_at:t period_days:i", TRENDING_RESULT, "texts words")(
    lambda t: _full(t)["trending_keywords"])
query("job_full_pipeline_trending_all_terms", "text weight:d count:i generated_at:t period_days:i", all_terms(TRENDING_RESULT), "texts words")(
    lambda t: _full(t, None)["trending_keywords"])
query("job_full_pipeline_reviews", "review_id:i processed:b words:i", """
SELECT review_id, TRUE AS processed, CASE WHEN review_id % 4 <> 0 AND review_text <> '' THEN {c} END AS words FROM texts""".format(c=_COUNTS), "texts")(
    lambda t: _full(t)["reviews"].select("review_id", F.col("processed_at").isNotNull().alias("processed"), F.col("word_count").alias("words")))
query("job_anomalies", "business_id business_name anomalies:i detected_at:t", ANOMALIES + """
SELECT source_id AS business_id, name AS business_name, coalesce(n, 0) AS anomalies, CASE WHEN n > 0 THEN TIMESTAMP '2001-11-01' ELSE TIMESTAMP '2000-11-01' END AS detected_at
FROM businesses LEFT JOIN (SELECT business_id, count(*) AS n FROM anomalies GROUP BY 1) AS a ON a.business_id = source_id""", "businesses reviews")(
    lambda t: jobs.anomalies(t.reviews, t.businesses, _old_anomalies(t), dt.datetime(2001, 11, 1), TIES)[0].withColumn("anomalies", F.size("anomalies")))


def _imported(t: Tables) -> dict[str, DataFrame]:
    none_b, none_r = (t.spark.createDataFrame([], s) for s in (schemas.BUSINESSES, schemas.REVIEWS))
    return jobs.import_places(places_json(t), details_json(t, "business_id"), none_b, none_r, TEXT_AS_OF, WIDE_LEXICON, S.STOP_WORDS)


query("job_import", "businesses:i reviews:i analytics:i", """
SELECT (SELECT 2 * count(*) FROM businesses) AS businesses, (SELECT count(*) + count(DISTINCT (business_id, review_date)) FROM texts WHERE review_text <> '') AS reviews,
 (SELECT count(DISTINCT business_id) FROM texts WHERE review_text <> '') AS analytics""", "businesses texts")(
    lambda t: _imported(t)["summary"])
query("job_import_analytics", "source_id total_reviews:i", """
SELECT business_id AS source_id, count(*) + count(DISTINCT review_date) AS total_reviews FROM texts WHERE review_text <> '' GROUP BY 1""", "texts")(
    lambda t: _imported(t)["analytics"].select("source_id", "total_reviews"))
query("job_import_businesses", "source_id source name address city state rating:d review_count:i category price_level:i latitude:d longitude:d last_updated:t",
      f"SELECT place_id AS source_id, 'google_places' AS source, TIMESTAMP '2024-11-30' AS last_updated, p.* FROM ({_PLACE_SQL}) AS p", "businesses")(
    lambda t: _imported(t)["businesses"])
# each response holds the text's own review and one anonymous review, which is the same for all texts of a business and a day
_FIXED_SUM = sum(WIDE_LEXICON.get(word, 0.0) for word in "a great place the best".split())
_IMPORTED = f"""
, sums AS (SELECT review_id, {_SUM} AS s FROM cleaned),
said AS (
 SELECT business_id, 'user ' || review_id AS reviewer_name, rating, review_text, review_date, s FROM texts JOIN sums USING (review_id) WHERE review_text <> ''
 UNION ALL SELECT DISTINCT business_id, 'Anonymous', 3, 'a great place, the best', review_date, {_FIXED_SUM} FROM texts WHERE review_text <> ''),
imported AS (
 SELECT * REPLACE (strptime(strftime(review_date, '%Y-%m-%d') || ' 10:20:30', '%Y-%m-%d %H:%M:%S') AS review_date), s / sqrt(s * s + 15) AS score FROM said)"""
query("job_import_reviews", "source business_id business_city business_category reviewer_name rating:i review_text review_date:t sentiment_score:d sentiment_label processed_at:t", f"""{_IMPORTED}
SELECT 'google_places' AS source, business_id, city AS business_city, CASE WHEN category IN ('Restaurant', 'Cafe', 'Bar') THEN category ELSE 'Service' END AS business_category,
 reviewer_name, i.rating, review_text, review_date, score AS sentiment_score, {_LABEL} AS sentiment_label, TIMESTAMP '2024-11-30' AS processed_at
FROM imported i JOIN businesses b ON source_id = business_id""", "businesses texts cleaned")(
    lambda t: _imported(t)["reviews"])
query("job_import_ratings", "source_id avg_rating:d total_reviews:i avg_sentiment:d latest_review:t earliest_review:t", f"""{_IMPORTED}
SELECT business_id AS source_id, avg(rating) AS avg_rating, count(*) AS total_reviews, avg(score) AS avg_sentiment, max(review_date) AS latest_review, min(review_date) AS earliest_review
FROM imported GROUP BY 1""", "texts cleaned")(
    lambda t: _imported(t)["analytics"])


def _place_reviews(t: Tables) -> DataFrame:
    """Landed reviews of every business under its place id."""
    return t.reviews.select(
        F.concat("source_review_id", F.lit("/"), "seq").alias("source_review_id"), "source", F.col("business_id").alias("place_id"), "rating", "review_date", "sentiment_score")


def _prefixed(t: Tables) -> DataFrame:
    return t.businesses.withColumns({
        "source_id": F.when(F.col("source") == "city_search", F.concat(F.lit("city_search_"), "source_id")).otherwise(F.col("source_id")),
        "reviews_fetched": F.when(F.col("price_level") == 0, True).when(F.col("price_level") == 1, False)})


_BACKLOG = "SELECT *, CASE WHEN source = 'city_search' THEN 'city_search_' ELSE '' END || source_id AS stored_id FROM businesses"


@query("job_enrich_backlog", "source_review_id source business_id business_name business_city", f"""
, b AS ({_BACKLOG}) SELECT * FROM (SELECT source_review_id || '/' || seq AS source_review_id, r.source, stored_id AS business_id, name AS business_name, city AS business_city,
 row_number() OVER (PARTITION BY source_review_id, seq, r.source ORDER BY review_date DESC, r.sentiment_score DESC) AS rn FROM reviews r JOIN b ON b.source_id = r.business_id WHERE price_level <> 0) AS x WHERE rn = 1""", "businesses reviews")
def _(t: Tables):
    stored = t.spark.createDataFrame([], schemas.REVIEWS)
    order = [F.col("review_date").desc(), F.col("sentiment_score").desc()]
    return jobs.enrich_backlog(_prefixed(t), _place_reviews(t), stored, dt.datetime(2001, 11, 1), None, order)[1]


@query("job_enrich_backlog_marks", "source_id place_id reviews_fetched:b", f"""
, b AS ({_BACKLOG}) SELECT stored_id AS source_id, CASE WHEN price_level <> 0 THEN source_id END AS place_id, TRUE AS reviews_fetched FROM b""", "businesses")
def _(t: Tables):
    stored = t.spark.createDataFrame([], schemas.REVIEWS)
    return jobs.enrich_backlog(_prefixed(t), _place_reviews(t), stored, dt.datetime(2001, 11, 1), None)[0]


def _stored_search(t: Tables, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    found = t.businesses.drop("source").withColumn("place_id", F.col("source_id"))
    landed = reviews.drop("source").withColumn("place_id", F.col("business_id"))
    stored = t.businesses.filter("price_level > 2").withColumn("place_id", F.col("source_id"))
    return jobs.store_search(
        found, landed, stored, t.spark.createDataFrame([], schemas.REVIEWS), dt.datetime(2001, 11, 1), windows.newest_first(*ALL_TIES))


query("job_store_search", "source_id name rating:d source reviews_fetched:b", """
SELECT source_id, name, rating, 'google_places_enhanced' AS source, TRUE AS reviews_fetched FROM businesses""", "businesses")(
    lambda t: _stored_search(t, t.reviews)[0])
# this SQL is of a search that gave the newest 20 reviews of each business: only those are landed here
query("job_store_search_reviews", "source_review_id source", f"""
, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY business_id {NEWEST}) AS rn FROM reviews) AS r WHERE rn <= 20)
SELECT DISTINCT source_review_id, 'google_places' AS source FROM n""", "reviews")(
    lambda t: _stored_search(t, windows.top_n_per_group(t.reviews, ["business_id"], windows.newest_first(*ALL_TIES), 20))[1])
query("job_store_search_all_reviews", "source_review_id source business_id business_name", f"""
SELECT source_review_id, 'google_places' AS source, business_id, name AS business_name FROM (
SELECT *, row_number() OVER (PARTITION BY source_review_id {NEWEST}) AS rn FROM reviews) AS r JOIN businesses b ON b.source_id = r.business_id WHERE rn = 1""", "businesses reviews")(
    lambda t: _stored_search(t, t.reviews)[1])
