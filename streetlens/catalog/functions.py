"""Queries of the scalar, text, sentiment and date functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetlens.catalog.base import Tables, query
from streetlens.catalog.relations import _TOP_PHRASES, _TOP_WORDS, CITY_QUERY, CLEAN_CITY, _queries
from streetlens.catalog.aggregates import SEGMENT
from streetlens.catalog.sql import LEXICON, RATING_SCORE, STOP_WORDS, clean, quoted
from streetlens.functions import scalars, sentiment, text
from streetlens.operators import enrich, lexicon
from streetlens.tasks.terms import word_lister

# -- text ---------------------------------------------------------------------------------------

query("txt_clean", "review_id:i cleaned", f"SELECT review_id, {clean('review_text')} AS cleaned FROM texts", "texts")(
    lambda t: t.texts.select("review_id", text.clean_text(F.col("review_text")).alias("cleaned")))
query("txt_api_keywords", "review_id:i keywords:l", "SELECT review_id, keywords FROM scored", "scored")(
    lambda t: t.texts.select("review_id", text.simple_keywords(F.col("review_text")).alias("keywords")))
_COUNTS = r"len(list_filter(regexp_split_to_array(review_text, '[ \t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda w: w <> ''))"
query("txt_counts", "review_id:i word_count:i character_count:i", f"SELECT review_id, {_COUNTS} AS word_count, length(review_text) AS character_count FROM texts", "texts")(
    lambda t: t.texts.select("review_id", text.word_count(F.col("review_text")).alias("word_count"), text.character_count(F.col("review_text")).alias("character_count")))

# -- sentiment ------------------------------------------------------------------------------------

query("sent_rating_keywords", "review_id:i score:d label confidence:d method", f"""
SELECT review_id, score, CASE WHEN score > 0.1 THEN 'positive' WHEN score < -0.1 THEN 'negative' ELSE 'neutral' END AS label,
 least(0.9, 0.5 + abs(score) * 0.5) AS confidence, 'rating_plus_keywords' AS method FROM (SELECT review_id, {RATING_SCORE} AS score FROM texts) AS s""", "texts")(
    lambda t: t.texts.select("review_id", sentiment.rating_sentiment(F.col("rating"), F.col("review_text")).alias("s")).select("review_id", "s.*"))
query("sent_rating_only", "source_review_id seq:i score:d label confidence:d method", """
SELECT source_review_id, seq, CASE WHEN rating >= 4 THEN 0.5 + (rating - 4) * 0.25 WHEN rating >= 3 THEN 0.0 ELSE -0.5 + (rating - 1) * 0.25 END AS score,
 CASE WHEN rating >= 4 THEN 'positive' WHEN rating >= 3 THEN 'neutral' ELSE 'negative' END AS label, 0.6 AS confidence, 'rating_only' AS method FROM reviews""", "reviews")(
    lambda t: t.reviews.select("source_review_id", "seq", sentiment.rating_sentiment(F.col("rating"), F.lit(None).cast("string")).alias("s")).select("source_review_id", "seq", "s.*"))

# words that occur in the given texts, so that scores differ
WIDE_LEXICON = {**LEXICON, **{w: 1.0 for w in ("the", "der", "la", "with")}, **{w: -1.0 for w in ("of", "und", "de", "from")}, "that": 0.5, "was": -1.5}
_SUM = "list_sum(list_concat([0.0], list_transform(words, lambda w: CASE w " + " ".join(f"WHEN '{w}' THEN {v}" for w, v in WIDE_LEXICON.items()) + " ELSE 0.0 END)))"
_HITS = f"len(list_filter(words, lambda w: list_contains([{quoted(WIDE_LEXICON)}], w)))"
_LABEL = "CASE WHEN score >= 0.05 THEN 'positive' WHEN score <= -0.05 THEN 'negative' ELSE 'neutral' END"
query("sent_lexicon", "review_id:i score:d label", f"""
SELECT *, {_LABEL} AS label FROM (SELECT review_id, s / sqrt(s * s + 15) AS score FROM (SELECT review_id, {_SUM} AS s FROM cleaned) AS x) AS y""", "cleaned")(
    lambda t: t.texts.select("review_id", sentiment.lexicon_score(F.col("review_text"), WIDE_LEXICON).alias("score")).withColumn("label", sentiment.label(F.col("score"))))
query("sent_lexicon_mean", "review_id:i score:d label", f"""
SELECT *, CASE WHEN score > 0.1 THEN 'positive' WHEN score < -0.1 THEN 'negative' ELSE 'neutral' END AS label FROM (
 SELECT review_id, CASE WHEN {_HITS} > 0 THEN {_SUM} / {_HITS} ELSE 0 END AS score FROM cleaned) AS y""", "cleaned")(
    lambda t: t.texts.select("review_id", sentiment.lexicon_score(F.col("review_text"), WIDE_LEXICON, "mean").alias("score")).withColumn(
        "label", sentiment.label(F.col("score"), 0.1, inclusive=False)))
# the phrases query opens a view of its own, so it becomes a nested WITH here
ENRICHED = f"""
, phrased AS ({_TOP_PHRASES.strip().replace(", pairs AS", "WITH pairs AS", 1)}),
keyed AS ({_TOP_WORDS}),
scores AS (SELECT review_id, s / sqrt(s * s + 15) AS score FROM (SELECT review_id, {_SUM} AS s FROM cleaned) AS x)
SELECT t.review_id, CASE WHEN full_ THEN score END AS sentiment_score, CASE WHEN full_ THEN {_LABEL} END AS sentiment_label, CASE WHEN full_ THEN keywords END AS keywords,
 CASE WHEN full_ THEN phrases END AS phrases, CASE WHEN full_ THEN {_COUNTS} END AS word_count, CASE WHEN full_ THEN length(review_text) END AS character_count
FROM (SELECT *, coalesce(length(review_text) > 0, FALSE) AS full_ FROM texts) t JOIN scores USING (review_id) JOIN keyed USING (review_id) JOIN phrased USING (review_id)"""
query("enrich_review", "review_id:i sentiment_score:d sentiment_label keywords:l phrases:l word_count:i character_count:i", ENRICHED, "texts words cleaned")(
    lambda t: enrich.enrich_reviews(t.texts, WIDE_LEXICON, stop_words=STOP_WORDS))

# lexicon and stop list as tables: of the fixed words, and of all different words of the texts
def _words(t: Tables) -> DataFrame:
    return t.texts.select(F.col("review_text").alias("body")).mapInArrow(word_lister, "word string").distinct()


def _fixed_lexicon(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(list(WIDE_LEXICON.items()), "word string, valence double")


def _all_words_lexicon(t: Tables) -> DataFrame:
    return _words(t).withColumn("valence", (F.length("word") % 5 - 2) / 2.0)


def _stop_table(t: Tables) -> DataFrame:
    return _words(t).filter("length(word) % 4 = 1")


_ALL_SUM = """, sums AS (SELECT c.review_id, coalesce(sum((length(w.word) % 5 - 2) / 2.0), 0) AS s, count(w.word) AS hits
 FROM cleaned c LEFT JOIN words w USING (review_id) GROUP BY 1)"""
query("sent_lexicon_table", "review_id:i score:d label", f"""
SELECT *, {_LABEL} AS label FROM (SELECT review_id, s / sqrt(s * s + 15) AS score FROM (SELECT review_id, {_SUM} AS s FROM cleaned) AS x) AS y""", "cleaned")(
    lambda t: lexicon.lexicon_scores(t.texts, _fixed_lexicon(t)).withColumn("label", sentiment.label(F.col("score"))))
query("sent_lexicon_all_words", "review_id:i score:d label", f"""{_ALL_SUM}
SELECT *, {_LABEL} AS label FROM (SELECT review_id, s / sqrt(s * s + 15) AS score FROM sums) AS y""", "cleaned words")(
    lambda t: lexicon.lexicon_scores(t.texts, _all_words_lexicon(t)).withColumn("label", sentiment.label(F.col("score"))))
query("sent_lexicon_mean_all_words", "review_id:i score:d label", f"""{_ALL_SUM}
SELECT *, CASE WHEN score > 0.1 THEN 'positive' WHEN score < -0.1 THEN 'negative' ELSE 'neutral' END AS label FROM (
 SELECT review_id, CASE WHEN hits > 0 THEN s / hits ELSE 0 END AS score FROM sums) AS y""", "cleaned words")(
    lambda t: lexicon.lexicon_scores(t.texts, _all_words_lexicon(t), mode="mean").withColumn("label", sentiment.label(F.col("score"), 0.1, inclusive=False)))
_STOP_LIST = f"word NOT IN ({quoted(STOP_WORDS)})"
_TABLE_ENRICHED = ENRICHED.replace(_STOP_LIST, "length(word) % 4 <> 1")
for _side in "ab":
    _TABLE_ENRICHED = _TABLE_ENRICHED.replace(f"{_side}.{_STOP_LIST}", f"length({_side}.word) % 4 <> 1").replace(f"{_side}.length(word)", f"length({_side}.word)")
_TABLE_ENRICHED = _TABLE_ENRICHED.replace(f"(SELECT review_id, {_SUM} AS s FROM cleaned)", "(SELECT review_id, s FROM sums)")
query("enrich_review_tables", "review_id:i sentiment_score:d sentiment_label keywords:l phrases:l word_count:i character_count:i", _ALL_SUM + _TABLE_ENRICHED, "texts words cleaned")(
    lambda t: enrich.enrich_with_tables(t.texts, _all_words_lexicon(t), _stop_table(t)))
query("scl_label", "source_review_id seq:i inclusive strict", """
SELECT source_review_id, seq, CASE WHEN v >= 0.05 THEN 'positive' WHEN v <= -0.05 THEN 'negative' ELSE 'neutral' END AS inclusive,
 CASE WHEN v > 0.1 THEN 'positive' WHEN v < -0.1 THEN 'negative' ELSE 'neutral' END AS strict FROM (SELECT *, round(sentiment_score / 4, 2) AS v FROM reviews) AS r""", "reviews")(
    lambda t: t.reviews.withColumn("v", F.round(F.col("sentiment_score") / 4, 2)).select(
        "source_review_id", "seq", sentiment.label(F.col("v")).alias("inclusive"), sentiment.label(F.col("v"), 0.1, inclusive=False).alias("strict")))

# -- businesses ---------------------------------------------------------------------------------------

query("scl_segment", "source_id segment", f"SELECT source_id, {SEGMENT} AS segment FROM businesses", "businesses")(
    lambda t: t.businesses.select("source_id", scalars.segment(F.col("rating"), F.col("review_count")).alias("segment")))
_ENUM = "CASE price_level WHEN 0 THEN 'PRICE_LEVEL_FREE' WHEN 1 THEN 'PRICE_LEVEL_MODERATE' WHEN 2 THEN 'PRICE_LEVEL_EXPENSIVE' WHEN 3 THEN 'PRICE_LEVEL_VERY_EXPENSIVE' ELSE 'other' END"
query("scl_price_enum", "source_id level:i", "SELECT source_id, CASE price_level WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 END AS level FROM businesses", "businesses")(
    lambda t: t.businesses.select("source_id", scalars.price_level(F.expr(_ENUM)).alias("level")))
query("scl_price_dollars", "source_id shown imported", """
SELECT source_id, CASE WHEN price_level BETWEEN 1 AND 4 THEN repeat('$', price_level) ELSE '$$' END AS shown, repeat('$', coalesce(nullif(price_level, 0), 1)) AS imported FROM businesses""", "businesses")(
    lambda t: t.businesses.select("source_id", scalars.price_dollars(F.col("price_level")).alias("shown"), scalars.price_dollars_import(F.col("price_level")).alias("imported")))
_ADDRESS = ("CASE c_custkey % 5 WHEN 0 THEN '12 High St, Austin, TX 78701, USA' WHEN 1 THEN concat(c_name, ', Lyon') WHEN 2 THEN c_name WHEN 3 THEN '' "
            "ELSE concat('9 Rue, ', c_mktsegment, ', Ontario') END")
query("scl_city_region", "customer:i city region", f"""
WITH q AS (SELECT c_custkey AS customer, {CITY_QUERY} AS q, {_ADDRESS} AS a FROM customer), p AS (SELECT *, string_split(a, ', ') AS ap FROM q)
SELECT customer, trim(split_part(q, ',', 1)) AS city, CASE WHEN contains(q, ',') THEN trim(split_part(q, ',', 2)) WHEN len(ap) >= 3 THEN ap[-2] WHEN len(ap) = 2 THEN ap[-1] ELSE 'International' END AS region FROM p""")(
    lambda t: t.raw("customer").selectExpr("c_custkey AS customer", f"{CITY_QUERY} AS q", f"{_ADDRESS} AS a").select(
        "customer", scalars.city_region(F.col("q"), F.col("a")).alias("r")).select("customer", "r.*"))
query("scl_city_state", "customer:i city state", f"""
WITH q AS (SELECT c_custkey AS customer, {_ADDRESS} AS a FROM customer), p AS (SELECT *, list_transform(string_split(a, ','), lambda x: trim(x)) AS p FROM q)
SELECT customer, CASE WHEN a = '' THEN 'Unknown City' WHEN len(p) >= 3 THEN p[-3] ELSE p[1] END AS city,
 CASE WHEN a = '' THEN 'Unknown State' WHEN len(p) >= 3 THEN split_part(p[-2], ' ', 1) WHEN len(p) = 2 THEN split_part(p[2], ' ', 1) ELSE 'Unknown State' END AS state FROM p""")(
    lambda t: t.raw("customer").selectExpr("c_custkey AS customer", f"{_ADDRESS} AS a").select(
        "customer", scalars.city_state(F.col("a")).alias("r")).select("customer", "r.*"))
query("scl_clean_city", "customer:i city", f"WITH q AS (SELECT c_custkey AS customer, {CITY_QUERY} AS city_query FROM customer) SELECT customer, {CLEAN_CITY} AS city FROM q")(
    lambda t: _queries(t).select("customer", scalars.clean_city(F.col("city_query")).alias("city")))
query("scl_slug", "page_id:i slug full_slug", "SELECT page_id, split_part(list_extract(string_split(url, '/'), -1), '?', 1) AS slug, list_extract(string_split(url, '/'), -1) AS full_slug FROM pages")(
    lambda t: t.raw("pages").select("page_id", scalars.slug(F.col("url")).alias("slug"), scalars.slug(F.col("url"), cut_query=False).alias("full_slug")))
_STARS = "CASE s_suppkey % 4 WHEN 0 THEN concat(CAST(s_suppkey % 5 AS VARCHAR(9)), '.5 star rating') WHEN 1 THEN concat(CAST(s_suppkey % 5 AS VARCHAR(9)), ' stars') WHEN 2 THEN 'not rated' END"
_VISITS = "CASE s_suppkey % 3 WHEN 0 THEN concat('1,', CAST(100 + s_suppkey % 900 AS VARCHAR(9)), ' reviews') WHEN 1 THEN 'no reviews' END"
query("scl_numbers", "supplier:i stars:d visits:i", f"""
SELECT s_suppkey AS supplier, TRY_CAST(regexp_extract({_STARS}, '(\\d+\\.?\\d*) star', 1) AS DOUBLE) AS stars,
 CASE WHEN {_VISITS} IS NOT NULL THEN coalesce(TRY_CAST(regexp_extract(replace({_VISITS}, ',', ''), '(\\d+)', 1) AS INT), 0) END AS visits FROM supplier""")(
    lambda t: t.raw("supplier").select(F.col("s_suppkey").alias("supplier"), scalars.star_rating(F.expr(_STARS)).alias("stars"), scalars.leading_count(F.expr(_VISITS)).alias("visits")))

_SCRIPT = """concat('{"mapMarkerProps":{"latitude":', CAST(s_suppkey * 3 % 90 - 45 AS STRING), '.25,"longitude":-', CAST(s_suppkey AS STRING), '.5}}')"""
query("scl_coords", "supplier:i latitude:d longitude:d", "SELECT s_suppkey AS supplier, CAST(concat(s_suppkey * 3 % 90 - 45, '.25') AS DOUBLE) AS latitude, -(s_suppkey + 0.5) AS longitude FROM supplier")(
    lambda t: t.raw("supplier").select(F.col("s_suppkey").alias("supplier"), scalars.coordinate(F.expr(_SCRIPT), "latitude").alias("latitude"), scalars.coordinate(F.expr(_SCRIPT), "longitude").alias("longitude")))
query("scl_dates", "source_review_id seq:i parsed:t", """
SELECT source_review_id, seq, CASE seq % 3 WHEN 0 THEN date_trunc('day', review_date) WHEN 1 THEN review_date END AS parsed FROM reviews""", "reviews")(
    lambda t: t.reviews.withColumn("shown", F.when(F.col("seq") % 3 == 0, F.date_format("review_date", "MM/dd/yyyy")).when(
        F.col("seq") % 3 == 1, F.date_format("review_date", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("last week")).select(
        "source_review_id", "seq", scalars.parse_date(F.col("shown")).alias("parsed")))
query("scl_point", "source_id lon:d lat:d", """
SELECT source_id, CASE WHEN price_level > 1 THEN longitude END AS lon, CASE WHEN price_level > 1 THEN latitude END AS lat FROM businesses""", "businesses")(
    lambda t: t.businesses.select("source_id", scalars.point(
        F.when(F.col("price_level") == 0, 0.0).otherwise(F.col("longitude")), F.when(F.col("price_level") != 1, F.col("latitude"))).alias("p")).select("source_id", "p.lon", "p.lat"))
query("scl_stamp", "source_review_id seq:i last_updated:t", "SELECT source_review_id, seq, coalesce(CASE WHEN seq % 2 = 0 THEN review_date END, TIMESTAMP '2001-11-01') AS last_updated FROM reviews", "reviews")(
    lambda t: t.reviews.select("source_review_id", "seq", scalars.stamp(F.when(F.col("seq") % 2 == 0, F.col("review_date")), F.expr("TIMESTAMP_NTZ '2001-11-01 00:00:00'")).alias("last_updated")))
query("scl_strip_prefix", "source_id place_id", "SELECT source_id, source_id AS place_id FROM businesses", "businesses")(
    lambda t: t.businesses.select("source_id", scalars.strip_prefix(F.when(F.col("source") == "city_search", F.concat(F.lit("city_search_"), "source_id")).otherwise(F.col("source_id"))).alias("place_id")))
query("scl_review_key", "review_id:i review_key", "SELECT review_id, sha256(concat(business_id, chr(31), rating, chr(31), review_text)) AS review_key FROM texts", "texts")(
    lambda t: t.texts.select("review_id", scalars.review_key(F.col("business_id"), F.col("rating"), F.col("review_text")).alias("review_key")))
query("scl_period", "source_review_id:i month week day hour:i weekday", """
SELECT source_review_id, strftime(review_date, '%Y-%m') AS month, strftime(date_trunc('week', review_date), '%Y-%m-%d') || '/' || strftime(date_trunc('week', review_date) + INTERVAL 6 DAY, '%Y-%m-%d') AS week,
 strftime(review_date, '%Y-%m-%d') AS day, extract(hour FROM review_date) AS hour, dayname(review_date) AS weekday FROM clicks""", "clicks")(
    lambda t: t.clicks.select("source_review_id", *[scalars.period_label(F.col("review_date"), p).alias(p) for p in ("month", "week", "day")],
                              F.hour("review_date").alias("hour"), F.date_format("review_date", "EEEE").alias("weekday")))
query("scl_hour_label", "source_review_id:i label", "SELECT source_review_id, CAST(strftime(review_date, '%I') AS INT) || strftime(review_date, ' %p') AS label FROM clicks", "clicks")(
    lambda t: t.clicks.select("source_review_id", scalars.hour_label(F.hour("review_date")).alias("label")))


@query("scl_hours_text", "supplier:i lines:l", """
SELECT s_suppkey AS supplier, [list_extract(['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday'], CAST(s_suppkey % 7 + 1 AS INT)) || ': 0900 - 1700', 'Sunday: 1000 - '] AS lines FROM supplier""")
def _(t: Tables):
    def slot(day, opens, closes):
        return F.struct(F.struct(day.alias("day"), opens.alias("time")).alias("open"), closes.alias("close"))
    close = lambda time: F.struct(F.lit(0).alias("day"), time.alias("time"))
    none = F.lit(None).cast("struct<day:int,time:string>")
    periods = F.array(
        slot((F.col("s_suppkey") % 7).cast("int"), F.lit("0900"), close(F.lit("1700"))),
        slot(F.lit(3), F.lit("0800"), none),
        slot(F.lit(None).cast("int"), F.lit("1000"), close(F.lit(None).cast("string"))),
        slot(F.lit(9), F.lit("1100"), close(F.lit("1200"))),
    )
    return t.raw("supplier").select(F.col("s_suppkey").alias("supplier"), scalars.hours_text(periods).alias("lines"))
