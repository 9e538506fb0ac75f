"""Queries of the sources (landed JSON and HTML) and of the sinks."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetlens import schemas
from streetlens.catalog.base import Tables, query
from streetlens.catalog.relations import ALL_TIES, ANOMALIES, NEWEST, TIES
from streetlens.operators import windows
from streetlens.session import scratch_path
from streetlens.sinks import layout, maintenance, tables, upsert
from streetlens.sources import pages, places
from streetlens.sources.collections import read_collection

AS_OF = dt.datetime(2001, 11, 1)

# -- landed JSON, built from the given tables ---------------------------------------------------

query("src_collection", "o_orderkey:i o_orderstatus o_totalprice:d", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")(
    lambda t: read_collection(t.spark, f"{t.sf_dir}/orders.parquet", t.raw("orders").schema, ["o_orderkey", "o_orderstatus", "o_totalprice"]))


def _nothing(kind: str):
    return F.lit(None).cast(kind)


def places_json(t: Tables) -> DataFrame:
    """One search response per business: the full place, and the bare id of a second one."""
    b = t.businesses
    types = F.array(F.lit("point_of_interest"), F.lower("category"))
    text = F.struct(F.col("name").alias("text"))
    point = F.struct("latitude", "longitude")
    enum = F.expr("CASE price_level WHEN 1 THEN 'PRICE_LEVEL_INEXPENSIVE' WHEN 2 THEN 'PRICE_LEVEL_MODERATE' WHEN 3 THEN 'PRICE_LEVEL_EXPENSIVE' END")
    full = F.struct(
        F.col("source_id").alias("id"), text.alias("displayName"), F.concat_ws(", ", "address", "state").alias("formattedAddress"),
        F.col("rating"), F.col("review_count").alias("userRatingCount"), point.alias("location"), types.alias("types"),
        F.lit("555-0100").alias("nationalPhoneNumber"), enum.alias("priceLevel"))
    bare = F.struct(
        F.concat("source_id", F.lit("_bare")).alias("id"), _nothing("struct<text:string>").alias("displayName"), _nothing("string").alias("formattedAddress"),
        _nothing("double").alias("rating"), _nothing("int").alias("userRatingCount"), _nothing("struct<latitude:double,longitude:double>").alias("location"),
        _nothing("array<string>").alias("types"), _nothing("string").alias("nationalPhoneNumber"), _nothing("string").alias("priceLevel"))
    return b.select(
        F.to_json(F.struct(F.array(full, bare).alias("places"))).alias("json"),
        F.when(F.col("price_level") % 2 == 0, F.concat("city", F.lit(", "), "state")).otherwise(F.col("city")).alias("city_query"))


_PLACE_SQL = """
SELECT source_id AS place_id, name, concat(address, ', ', state) AS address, city, CASE WHEN price_level % 2 = 0 THEN state ELSE city END AS state,
 coalesce(rating, 4.0) AS rating, review_count, CASE category WHEN 'Restaurant' THEN 'Restaurant' WHEN 'Cafe' THEN 'Cafe' WHEN 'Bar' THEN 'Bar' ELSE 'Service' END AS category,
 CASE category WHEN 'Restaurant' THEN ['dining'] WHEN 'Cafe' THEN ['coffee', 'beverages'] WHEN 'Bar' THEN ['drinks', 'nightlife'] ELSE ['general'] END AS subcategory,
 '555-0100' AS phone, latitude, longitude, CASE price_level WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 END AS price_level FROM businesses
UNION ALL SELECT source_id || '_bare', 'Unknown Business', 'No address', city, CASE WHEN price_level % 2 = 0 THEN state ELSE 'International' END, 4.0, 0,
 'Service', ['general'], NULL, 0.0, 0.0, NULL FROM businesses"""
query("src_places_json", "place_id name address city state rating:d review_count:i category subcategory:l phone latitude:d longitude:d price_level:i", _PLACE_SQL, "businesses")(
    lambda t: places.businesses_from_places(places_json(t)))


def legacy_json(t: Tables) -> DataFrame:
    point = F.struct(F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lng")).alias("location"))
    place = F.struct(
        F.col("source_id").alias("place_id"), "name", F.concat_ws(", ", "address", "state").alias("vicinity"), "rating",
        F.col("review_count").alias("user_ratings_total"), F.array(F.lower("category")).alias("types"), "price_level", point.alias("geometry"))
    lost = place.withField("name", _nothing("string"))
    return t.businesses.select(F.to_json(F.struct(F.lit("OK").alias("status"), F.array(place, lost).alias("results"))).alias("json"))


query("src_places_json_legacy", "place_id name address city state rating:d review_count:i category subcategory:l latitude:d longitude:d price_level:i", """
SELECT source_id AS place_id, name, concat(address, ', ', state) AS address, city, state, coalesce(rating, 0) AS rating, review_count,
 CASE category WHEN 'Restaurant' THEN 'Restaurant' WHEN 'Cafe' THEN 'Cafe' ELSE 'Service' END AS category,
 CASE category WHEN 'Restaurant' THEN ['Dining'] WHEN 'Cafe' THEN ['Coffee'] ELSE ['General'] END AS subcategory, latitude, longitude, price_level FROM businesses""", "businesses")(
    lambda t: places.businesses_from_legacy(legacy_json(t)))


def details_json(t: Tables, place_id: str = "concat('place_', review_id)") -> DataFrame:
    """One details response per text: a review with the text, one translated, one without text."""
    def body(text, lang):
        return F.struct(text.alias("text"), lang.alias("languageCode"))
    nobody = _nothing("struct<text:string,languageCode:string>")
    author = F.struct(F.concat(F.lit("user "), F.col("review_id")).alias("displayName"), _nothing("string").alias("uri"), _nothing("string").alias("photoUri"))
    when = F.date_format("review_date", "yyyy-MM-dd'T'10:20:30'Z'")
    def review(who, text, original, rating):
        return F.struct(who.alias("authorAttribution"), text.alias("text"), original.alias("originalText"), when.alias("publishTime"),
                        F.lit("a while ago").alias("relativePublishTimeDescription"), rating.alias("rating"))
    reviews = F.array(
        review(author, body(F.lit("translated"), F.lit("en")), body(F.col("review_text"), F.col("lang")), F.col("rating")),
        review(_nothing("struct<displayName:string,uri:string,photoUri:string>"), body(F.lit("a great place, the best"), _nothing("string")), body(F.lit(""), _nothing("string")), F.lit(3)),
        review(author, nobody, nobody, F.lit(1)))
    hours = F.struct(F.array(F.struct(
        F.struct(F.lit(1).alias("day"), F.lit("0900").alias("time")).alias("open"), F.struct(F.lit(1).alias("day"), F.lit("1700").alias("time")).alias("close"))).alias("periods"))
    details = F.struct(
        F.struct(F.concat(F.lit("Place "), F.col("review_id")).alias("text")).alias("displayName"), F.lit("1 High St, Austin, TX 78701, USA").alias("formattedAddress"),
        F.lit(4.5).alias("rating"), F.lit(12).alias("userRatingCount"), F.struct(F.lit(30.5).alias("latitude"), F.lit(-97.5).alias("longitude")).alias("location"),
        F.array(*[F.lit(x) for x in ("cafe", "food", "store")]).alias("types"), F.lit("PRICE_LEVEL_MODERATE").alias("priceLevel"),
        hours.alias("regularOpeningHours"), reviews.alias("reviews"))
    return t.texts.select(F.expr(place_id).alias("place_id"), F.to_json(details).alias("json"))


query("src_place_reviews_json", "place_id business_name reviewer_name rating:i language review_date:t review_length:i sentiment_score:d sentiment_label sentiment_confidence:d sentiment_method keywords:l", """
SELECT concat('place_', review_id) AS place_id, concat('Place ', review_id) AS business_name, x.*, strptime(strftime(review_date, '%Y-%m-%d') || ' 10:20:30', '%Y-%m-%d %H:%M:%S') AS review_date
FROM (SELECT review_id, review_date, concat('user ', review_id) AS reviewer_name, rating, lang AS language, length(review_text) AS review_length, sentiment_score, sentiment_label,
 least(0.9, 0.5 + abs(sentiment_score) * 0.5) AS sentiment_confidence, 'rating_plus_keywords' AS sentiment_method, keywords FROM scored
UNION ALL SELECT review_id, review_date, 'Anonymous', 3, 'en', 23, 0.2, 'positive', 0.6, 'rating_plus_keywords', ['great', 'place', 'best'] FROM scored
UNION ALL SELECT review_id, review_date, concat('user ', review_id), 1, 'en', 0, -0.5, 'negative', 0.6, 'rating_only', [] FROM scored) AS x""".replace("x.*,", "x.* EXCLUDE (review_id, review_date),"), "scored")(
    lambda t: places.reviews_from_places(details_json(t)).withColumn("review_length", F.length("review_text")))
query("src_place_profile", "place_id name city state category subcategory:l hours:l reviews_fetched:i avg_sentiment:d positive:i neutral:i negative:i rating_1:i rating_3:i words:i", """
SELECT concat('place_', review_id) AS place_id, concat('Place ', review_id) AS name, 'Austin' AS city, 'TX' AS state, 'cafe' AS category, ['food', 'store'] AS subcategory, ['Monday: 0900 - 1700'] AS hours,
 3 AS reviews_fetched, (sentiment_score + 0.2 - 0.5) / 3 AS avg_sentiment, 1 + CAST(sentiment_label = 'positive' AS INT) AS positive, CAST(sentiment_label = 'neutral' AS INT) AS neutral,
 1 + CAST(sentiment_label = 'negative' AS INT) AS negative, 1 + CAST(rating = 1 AS INT) AS rating_1, 1 + CAST(rating = 3 AS INT) AS rating_3,
 least(20, len(list_distinct(list_concat(keywords, ['great', 'place', 'best'])))) AS words FROM scored""", "scored")(
    lambda t: places.profiles_from_places(details_json(t)).withColumns({"words": F.size("top_keywords"), "hours": F.col("opening_hours")}))

# -- landed pages ------------------------------------------------------------------------------

query("extract_page_names", "page_id:i name", """
SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '<h1>([^<]+)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)),
 '&nbsp;', chr(160)), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&') AS name FROM pages""")(
    lambda t: t.raw("pages").select("page_id", pages.page_name(F.col("html")).alias("name")))


def business_pages(t: Tables) -> DataFrame:
    """A business page per business, in the markup of a review site."""
    return t.businesses.selectExpr(
        "concat('https://site.example/biz/', source_id, '?osq=x') AS url",
        """concat('<html><body><h1 class="css">', name, ' &amp; Co</h1><div data-testid="rating"><span aria-label="', coalesce(CAST(rating AS STRING), 'no'), ' star rating"></span></div>',
 '<a href="/biz/x#reviews"><span>1,', CAST(100 + review_count AS STRING), ' reviews</span></a><address data-testid="business-address"><p>', address, '</p><p>', state, '</p></address>',
 '<div data-testid="business-phone"><p>555-', CAST(1000 + review_count AS STRING), '</p></div><a href="/biz_redir?u=', source_id, '">site</a>',
 '<span data-testid="business-categories"><a href="#">', category, '</a><a href="#">Local</a></span><div data-testid="business-price"><span>', repeat('$', 1 + price_level), '</span></div>',
 '<table data-testid="business-hours"><tr><th>Mon</th><td><p>9 - 5</p></td></tr><tr><th>Tue</th><td><p>10 - 6</p></td></tr></table>',
 '<div data-testid="business-description"><p>About ', name, '</p></div>', repeat(concat('<div class="lemon photo-box big"><img alt="" src="/', source_id, '.jpg"></div>'), 3 + price_level),
 '<script>var a = 1;</script><script>{"mapMarkerProps":{"latitude":-', CAST(latitude AS STRING), ',"longitude":', CAST(longitude AS STRING), '}}</script></body></html>') AS html""")


query("extract_business_page", "source_id name rating:d review_count:i address phone website category subcategory:l price_range monday tuesday description images:i latitude:d longitude:d", """
SELECT source_id, name || ' & Co' AS name, rating, 1100 + review_count AS review_count, address || ' ' || state AS address, concat('555-', 1000 + review_count) AS phone, '/biz_redir?u=' || source_id AS website,
 category, ['Local'] AS subcategory, repeat('$', 1 + price_level) AS price_range, '9 - 5' AS monday, '10 - 6' AS tuesday, 'About ' || name AS description, 3 + price_level AS images, -latitude AS latitude, longitude FROM businesses""", "businesses")(
    lambda t: pages.extract_business_pages(business_pages(t)).withColumns({"monday": F.col("hours")["Mon"], "tuesday": F.col("hours")["Tue"], "images": F.size("images")}))


def review_pages(t: Tables) -> DataFrame:
    """A review page per review row: two reviews, one of them without text."""
    return t.reviews.selectExpr(
        "business_id", "concat('Shop ', business_id) AS business_name", "seq",
        """concat('<html><section data-testid="reviews-list"><div><span class="user-name"><a href="/user/', source_review_id, '">Ann</a></span><div role="img" aria-label="', CAST(rating AS STRING), ' star rating"></div>',
 '<span class="review-date">', date_format(review_date, 'M/d/yyyy'), '</span><div class="comment big"><p lang="en">Seen ', source_review_id, '</p></div><span class="helpful-count">', CAST(seq AS STRING), ' found it helpful</span></div>',
 '<div><span class="user-name"><a href="/user/none">Bob</a></span><div class="comment"><p></p></div></div></section></html>') AS html""")


query("extract_review_page", "source_review_id business_id business_name reviewer_name reviewer_id rating:i review_text review_date:t helpful_votes:i", """
SELECT concat(business_id, '_/user/', source_review_id) AS source_review_id, business_id, concat('Shop ', business_id) AS business_name, 'Ann' AS reviewer_name, concat('/user/', source_review_id) AS reviewer_id,
 rating, concat('Seen ', source_review_id) AS review_text, date_trunc('day', review_date) AS review_date, seq AS helpful_votes FROM reviews""", "reviews")(
    lambda t: pages.extract_review_pages(review_pages(t)))


def directory_pages(t: Tables) -> DataFrame:
    return t.businesses.selectExpr(
        "concat('https://dir.example/mip/', source_id, '?lid=1') AS url",
        """concat('<html>', CASE WHEN price_level = 4 THEN '' ELSE concat('<h1>', name, '</h1>') END, '<h2 class="address"><span>', address, '</span><span>', state, '</span></h2><p class="phone dockable">555-01</p>',
 '<a class="link" href="http://', source_id, '.example" title="Website">Visit</a><div class="categories"><a>', category, '</a><a>Shops</a><a>More</a></div>',
 '<time class="hours-info">Mon 9-5</time><time class="hours-info">Tue 9-6</time><section class="description"><p>Since 1990</p></section></html>') AS html""")


query("extract_directory_page", "source_id name address phone website category subcategory:l hours_text description", """
SELECT source_id || '?lid=1' AS source_id, name, address || ' ' || state AS address, '555-01' AS phone, 'http://' || source_id || '.example' AS website, category, ['Shops', 'More'] AS subcategory,
 'Mon 9-5 Tue 9-6' AS hours_text, 'Since 1990' AS description FROM businesses WHERE price_level <> 4""", "businesses")(
    lambda t: pages.extract_directory_pages(directory_pages(t)).withColumn("hours_text", F.col("hours")["*"]))


def card_pages(t: Tables) -> DataFrame:
    card = """concat('<div class="g" data-cid="', source_id, '-', CAST(i AS STRING), '"><h3>', name, ' ', CAST(i AS STRING), '</h3><span role="img" aria-label="', CAST(i AS STRING), '.5 stars"></span><span>1,20', CAST(i % 10 AS STRING), ' reviews</span></div>')"""
    return t.businesses.selectExpr(
        "concat('https://search.example/', source_id) AS url", f"concat('<html>', array_join(transform(sequence(1, 9 + price_level), i -> {card}), ''), '</html>') AS html")


query("extract_search_cards", "url source_id name rating:d review_count:i", """
SELECT concat('https://search.example/', source_id) AS url, concat(source_id, '-', i) AS source_id, concat(name, ' ', i) AS name, i + 0.5 AS rating, 1200 + i % 10 AS review_count
FROM businesses, range(1, 20) AS r(i) WHERE i <= 9 + price_level""", "businesses")(lambda t: pages.extract_search_cards(card_pages(t)))
query("extract_links", "page_id:i position:i link", """
SELECT page_id, i - 1 AS position, link FROM (SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) AS i FROM (
 SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS l FROM pages) AS x) AS y WHERE starts_with(link, '/')""")(
    lambda t: pages.extract_links(t.raw("pages").withColumn("url", F.col("page_id")), "/").withColumn("page_id", F.col("url")))
query("extract_next_page", "url next_url", "SELECT concat('https://search.example/', source_id) AS url, concat('/search?start=', review_count) AS next_url FROM businesses WHERE price_level > 0", "businesses")(
    lambda t: pages.next_page(t.businesses.selectExpr(
        "concat('https://search.example/', source_id) AS url",
        "CASE price_level WHEN 0 THEN '<a href=\"/x\">x</a>' WHEN 1 THEN concat('<a class=\"btn next\" href=\"/search?start=', CAST(review_count AS STRING), '\">') ELSE concat('<a href=\"/search?start=', CAST(review_count AS STRING), '\" aria-label=\"Next\">') END AS html")))

# -- upserts: the stored half of the rows against a batch of changed and new ones --------------------

_STORED = "CAST(split_part(source_id, '_', 2) AS BIGINT) % 3 <> 0"
_STORED_EXPR = "CAST(substring_index(source_id, '_', -1) AS BIGINT) % 3 <> 0"


def _batch(b: DataFrame) -> DataFrame:
    """Two versions of every second business; the later one has a null rating now and then."""
    some = b.filter("review_count % 2 = 0")
    versions = some.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
    return versions.select("source_id", "source", F.concat("name", F.lit(" v"), "version").alias("name"),
                           F.when(F.col("price_level") != 2, F.col("rating") + F.col("version")).alias("rating"), "version")


def _upserted(t: Tables, by_place: bool) -> DataFrame:
    target, batch = t.businesses.filter(_STORED_EXPR).select("source_id", "source", "name", "city", "rating"), _batch(t.businesses)
    if by_place:
        target = target.withColumn("place_id", F.concat(F.lit("p_"), "source_id"))
        batch = batch.withColumn("place_id", F.concat(F.lit("p_"), "source_id"))
        return upsert.upsert_businesses_by_place(target, batch, [F.col("version").desc()])
    return upsert.upsert_businesses(target, batch, [F.col("version").desc()])


_UPSERTED = f"""
SELECT source_id, source, CASE WHEN review_count % 2 = 0 THEN name || ' v2' ELSE name END AS name, CASE WHEN {_STORED} THEN city END AS city,
 CASE WHEN review_count % 2 = 0 THEN CASE WHEN price_level <> 2 THEN rating + 2 END ELSE rating END AS rating FROM businesses WHERE review_count % 2 = 0 OR {_STORED}"""
query("upsert_businesses", "source_id source name city rating:d", _UPSERTED, "businesses")(lambda t: _upserted(t, False))
query("upsert_businesses_by_place", "source_id source name city rating:d", _UPSERTED, "businesses")(lambda t: _upserted(t, True))


def _split_reviews(t: Tables) -> tuple[DataFrame, DataFrame]:
    target = windows.latest_per_key(t.reviews.filter("seq % 2 = 0"), upsert.REVIEW_KEY, windows.newest_first(*ALL_TIES))
    return target, t.reviews.filter("seq % 2 = 1")


_FIRST = "(SELECT *, row_number() OVER (PARTITION BY source_review_id, source {o}) AS rn FROM reviews WHERE seq % 2 = {h}) AS x"
query("upsert_reviews", "source_review_id source seq:i rating:i sentiment_score:d review_date:t", f"""
, a AS (SELECT * FROM {_FIRST.format(o=NEWEST, h=0)} WHERE rn = 1), b AS (SELECT * FROM {_FIRST.format(o=NEWEST, h=1)} WHERE rn = 1)
SELECT * FROM b UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.source_review_id = a.source_review_id AND b.source = a.source)""", "reviews")(
    lambda t: upsert.upsert_reviews(*_split_reviews(t), windows.newest_first(*ALL_TIES)))


def _events(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Every event twice as stored and landed rows; orders give the landed events coordinates."""
    base = t.raw("events").selectExpr(
        "concat('e', CAST(event_id AS STRING)) AS source_id", "event_type AS source", "concat('Event ', CAST(event_id AS STRING)) AS name",
        "CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE 10.5 END AS latitude", "CAST(user_id AS DOUBLE) + 1 AS longitude", "event_id")
    return base.filter("event_id % 3 <> 0").drop("event_id"), base.filter("event_id % 2 = 0").withColumn("name", F.concat("name", F.lit(" new"))).drop("event_id")


query("upsert_events", "source_id source name lon:d lat:d", """
SELECT 'e' || event_id AS source_id, event_type AS source, 'Event ' || event_id || CASE WHEN event_id % 2 = 0 THEN ' new' ELSE '' END AS name,
 CASE WHEN event_id % 2 = 0 AND event_id % 5 <> 0 THEN user_id + 1.0 END AS lon, CASE WHEN event_id % 2 = 0 AND event_id % 5 <> 0 THEN 10.5 END AS lat FROM events WHERE event_id % 3 <> 0 OR event_id % 2 = 0""")(
    lambda t: upsert.upsert_events(*_events(t), [F.col("name")]).select("source_id", "source", "name", "location.lon", "location.lat"))


def _anomaly_records(t: Tables) -> DataFrame:
    return windows.anomaly_records(windows.rating_anomalies(t.reviews, ties=TIES), t.businesses, F.lit(AS_OF))


def _old_anomalies(t: Tables) -> DataFrame:
    """Stored records of every business, empty, from a year before."""
    return t.businesses.select(
        F.col("source_id").alias("business_id"), F.col("name").alias("business_name"),
        F.array().cast(schemas.RATING_ANOMALIES["anomalies"].dataType).alias("anomalies"), F.lit(dt.datetime(2000, 11, 1)).alias("detected_at"))


query("upsert_anomalies", "business_id business_name anomalies:i detected_at:t", ANOMALIES + """
SELECT source_id AS business_id, name AS business_name, coalesce(n, 0) AS anomalies, CASE WHEN n > 0 THEN TIMESTAMP '2001-11-01' ELSE TIMESTAMP '2000-11-01' END AS detected_at
FROM businesses LEFT JOIN (SELECT business_id, count(*) AS n FROM anomalies GROUP BY 1) AS a ON a.business_id = source_id""", "businesses reviews")(
    lambda t: upsert.upsert_anomalies(_old_anomalies(t), _anomaly_records(t), [F.col("detected_at").desc()]).withColumn("anomalies", F.size("anomalies")))
query("update_columns", "source_id name rating:d", """
SELECT source_id, name, CASE WHEN price_level = 1 THEN 5.0 WHEN price_level = 2 THEN NULL ELSE rating END AS rating FROM businesses""", "businesses")(
    lambda t: upsert.update_columns(t.businesses, t.businesses.filter("price_level IN (1, 2)").select(
        F.explode(F.array("source_id", F.concat("source_id", F.lit("_unknown")))).alias("source_id"), F.expr("CASE price_level WHEN 1 THEN CAST(5 AS DOUBLE) END").alias("rating")), ["source_id"]))

# -- replacing, exporting, deleting --------------------------------------------------------------------

@query("replace_table", "keyword count:i period_days:i", "SELECT keyword, count(*) AS count, 7 AS period_days FROM (SELECT unnest(keywords) AS keyword FROM scored) AS k GROUP BY 1", "scored")
def _(t: Tables):
    counts = t.scored.select(F.explode("keywords").alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("count"))
    return tables.replace_table(counts.withColumn("period_days", F.lit(7)), scratch_path(t.spark, "trending"))


@query("export_json", "source_review_id:i review_date rating:i created_at", """
SELECT source_review_id, strftime(review_date, '%Y-%m-%dT%H:%M:%S.%f') AS review_date, rating, '2001-11-01T00:00:00.000000' AS created_at FROM clicks""", "clicks")
def _(t: Tables):
    paths = tables.export_json({"clicks": t.clicks}, scratch_path(t.spark, "export"), F.lit(AS_OF))
    return t.spark.read.schema("source_review_id bigint, review_date string, rating int, created_at string").json(paths["clicks"])


B = "source_id name city source"
R = "source_review_id seq:i business_id source"
query("delete_by_source", B, "SELECT * FROM businesses WHERE source <> 'city_search'", "businesses")(lambda t: maintenance.delete_by_source(t.businesses, "city_search"))
query("delete_by_source_reviews", R, "SELECT * FROM reviews WHERE source <> 'city_search'", "reviews")(lambda t: maintenance.delete_by_source(t.reviews, "city_search"))
_GONE = "regexp_matches(city, 'NATION_1', 'i')"
query("delete_by_city", B, f"SELECT * FROM businesses WHERE NOT ({_GONE} OR regexp_matches(address, 'NATION_1', 'i'))", "businesses")(
    lambda t: maintenance.delete_businesses_by_city(t.businesses, "NATION_1"))
query("delete_by_city_reviews", R, f"""
SELECT * FROM named_reviews WHERE NOT (regexp_matches(business_city, 'NATION_1', 'i') OR business_name IN (SELECT name FROM businesses WHERE {_GONE} OR regexp_matches(address, 'NATION_1', 'i')))""", "named_reviews")(
    lambda t: maintenance.delete_reviews_by_city(t.businesses, t.named_reviews, "NATION_1"))
query("delete_by_city_names", R, f"SELECT * FROM named_reviews WHERE business_name NOT IN (SELECT name FROM businesses WHERE {_GONE})", "named_reviews")(
    lambda t: maintenance.delete_reviews_by_city(t.businesses, t.named_reviews, "NATION_1", address_too=False))
query("truncate_all", B, "SELECT * FROM businesses WHERE FALSE", "businesses")(lambda t: maintenance.truncate(t.businesses))
query("delete_all_sources", R, "SELECT * FROM (SELECT * REPLACE (CASE WHEN seq % 10 > 0 THEN source END AS source) FROM reviews) AS r WHERE source IS NULL", "reviews")(
    lambda t: maintenance.delete_all_sources(t.reviews.withColumn("source", F.when(F.col("seq") % 10 > 0, F.col("source"))), t.businesses))
query("retention_cleanup", "source_review_id seq:i generated_at:t", """
SELECT source_review_id, seq, CASE WHEN seq % 7 > 0 THEN review_date END AS generated_at FROM reviews WHERE NOT coalesce(seq % 7 > 0 AND review_date < TIMESTAMP '2001-08-03', FALSE)""", "reviews")(
    lambda t: maintenance.retention_cleanup(t.reviews.withColumn("generated_at", F.when(F.col("seq") % 7 > 0, F.col("review_date"))), AS_OF))


# -- the same on tables laid out in folders and buckets ---------------------------------------------------

def _folders(t: Tables, df: DataFrame, by: str) -> tuple:
    path = scratch_path(t.spark, "folders")
    layout.write_folders(df, path, by)
    return t.spark, path, df.schema


query("delete_by_source_folders", R, "SELECT * FROM reviews WHERE source <> 'city_search'", "reviews")(
    lambda t: layout.delete_source(*_folders(t, t.reviews, "source"), "city_search"))
query("delete_by_city_folders", B, f"SELECT * FROM businesses WHERE NOT ({_GONE} OR regexp_matches(address, 'NATION_1', 'i'))", "businesses")(
    lambda t: layout.delete_business_city(*_folders(t, t.businesses, "city"), "city", "NATION_1"))
query("delete_by_city_reviews_folders", R, f"""
SELECT * FROM named_reviews WHERE NOT (regexp_matches(business_city, 'NATION_1', 'i') OR business_name IN (SELECT name FROM businesses WHERE {_GONE} OR regexp_matches(address, 'NATION_1', 'i')))""", "named_reviews")(
    lambda t: layout.delete_review_city(*_folders(t, t.named_reviews, "business_city"), "business_city", t.businesses, "NATION_1"))


@query("retention_cleanup_folders", "source_review_id seq:i generated_at:t", """
SELECT source_review_id, seq, CASE WHEN seq % 7 > 0 THEN review_date END AS generated_at FROM reviews WHERE NOT coalesce(seq % 7 > 0 AND review_date < TIMESTAMP '2001-08-03', FALSE)""", "reviews")
def _(t: Tables):
    dated = t.reviews.withColumn("generated_at", F.when(F.col("seq") % 7 > 0, F.col("review_date"))).withColumn("month", layout.month_of("generated_at"))
    # a month becomes a few files, not one of each task; AQE splits a hot one
    return layout.retention(*_folders(t, dated.hint("rebalance", F.col("month")), "month"), AS_OF)


@query("upsert_reviews_buckets", "source_review_id source seq:i rating:i sentiment_score:d review_date:t", f"""
, a AS (SELECT * FROM {_FIRST.format(o=NEWEST, h=0)} WHERE rn = 1), b AS (SELECT * FROM {_FIRST.format(o=NEWEST, h=1)} WHERE rn = 1)
SELECT * FROM b UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.source_review_id = a.source_review_id AND b.source = a.source)""", "reviews")
def _(t: Tables):
    target, batch = _split_reviews(t)
    path = scratch_path(t.spark, "reviews")
    held = layout.write_buckets(target, os.path.basename(path).replace("-", "_"), upsert.REVIEW_KEY, 16, path)
    return layout.upsert_buckets(held, batch, upsert.REVIEW_KEY, windows.newest_first(*ALL_TIES))
