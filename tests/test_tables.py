import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from streetlens.operators import aggregates, filters, joins, windows
from streetlens.sinks import maintenance, tables, upsert
from streetlens.sources import pages, places
from streetlens.streaming import streams

KEYS = ["k", "source"]


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([("a", "x", 1, "keep"), ("b", "x", 2, "keep"), (None, "x", 3, "keep")], "k string, source string, v int, other string")


def test_upsert_overlays_inserts_and_is_idempotent(spark, target):
    batch = spark.createDataFrame(
        [("a", "x", 10, 1), ("a", "x", None, 2), ("c", "x", 7, 1), (None, "x", 9, 1)], "k string, source string, v int, seq int")
    once = upsert.upsert(target, batch, KEYS, [F.col("seq").desc()]).drop("seq")
    want = {("a", "x", None, "keep"), ("b", "x", 2, "keep"), (None, "x", 9, "keep"), ("c", "x", 7, None)}
    assert {tuple(r) for r in once.collect()} == want
    again = upsert.upsert(once, batch, KEYS, [F.col("seq").desc()]).drop("seq")
    assert {tuple(r) for r in again.collect()} == want


def test_update_columns_never_inserts(spark, target):
    changes = spark.createDataFrame([("a", "x", 5), ("zz", "x", 6)], "k string, source string, v int")
    got = {r.k: r.v for r in upsert.update_columns(target, changes, KEYS).collect()}
    assert got == {"a": 5, "b": 2, None: 3}


def test_deleted_and_kept_rows_make_the_whole(spark):
    b = spark.createDataFrame([("1", "Shop", "Rome", "x", "s1"), ("2", "Bar", None, "Via Roma, Rome", None), ("3", None, "Oslo", None, "s2")],
                              "source_id string, name string, city string, address string, source string")
    r = spark.createDataFrame([("Shop", "Oslo"), ("Bar", None), ("Pub", "Rome"), (None, None)], "business_name string, business_city string")
    assert {x.source_id for x in maintenance.delete_businesses_by_city(b, "rome").collect()} == {"3"}
    assert {x.source_id for x in maintenance.delete_businesses_by_city(b, "rome", address_too=False).collect()} == {"2", "3"}
    assert {x.business_name for x in maintenance.delete_reviews_by_city(b, r, "rome").collect()} == {None}
    assert {x.business_name for x in maintenance.delete_reviews_by_city(b, r, "rome", address_too=False).collect()} == {"Bar", "Pub", None}
    # no business in the city: nothing is deleted
    assert maintenance.delete_reviews_by_city(b.filter("source_id = '3'"), r, "rome").count() == 4
    assert {x.source_id for x in maintenance.delete_by_source(b, "s1").collect()} == {"2", "3"}
    assert {x.source_id for x in maintenance.delete_all_sources(b, b).collect()} == {"2"}


def test_export_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 2, 3, 4, 5), None)], "id int, at timestamp, note string")
    paths = tables.export_json({"t": df}, str(tmp_path))
    row = spark.read.json(paths["t"]).first()
    assert row.at == "2024-01-02T03:04:05.000000" and row.note is None


# -- filters -----------------------------------------------------------------------------------------

def test_null_names_pass_the_chain_exclusion(spark):
    df = spark.createDataFrame([("Starbucks #1",), ("Corner",), (None,)], "name string")
    assert {r.name for r in filters.by_chain(df, exclude=True).collect()} == {"Corner", None}
    assert {r.name for r in filters.by_chain(df, only=True).collect()} == {"Starbucks #1"}


def test_bounds_are_inclusive_and_segments_exact(spark):
    df = spark.createDataFrame([("a", 4.0, 50), ("b", 3.9, 50), ("c", 4.0, 49), ("d", None, 80)], "source_id string, rating double, review_count int")
    assert {r.source_id for r in filters.apply_focus(df, "market_leaders").collect()} == {"a"}
    assert {r.source_id for r in filters.by_review_volume(df, 50, 50).collect()} == {"a", "b"}
    assert filters.by_review_volume(df).count() == 4
    assert {r.source_id for r in filters.by_review_volume(df, max_reviews=10_000).collect()} == {"a", "b", "c", "d"}
    assert {r.source_id for r in filters.by_rating_range(df, 1.0, 5.0).collect()} == {"a", "b", "c"}
    assert filters.with_required_columns(df).columns == ["source_id", "rating", "review_count", "name", "category", "city"]


def test_period_presets():
    now = dt.datetime(2024, 6, 30)
    assert filters.period_range("all_time", now) is None
    assert filters.period_range("last_6_months", now) == (now - dt.timedelta(days=180), now)
    assert filters.period_range("custom", now, [dt.datetime(2024, 1, 1)]) == (dt.datetime(2024, 1, 1), now)


def test_any_date_takes_iso_strings_and_day_bounds(spark):
    df = spark.createDataFrame([(1, "2024-01-31T23:59:59Z", None), (2, "bad", dt.datetime(2024, 1, 1)), (3, "2024-02-01T00:00:00Z", None), (4, None, None)],
                               "id int, review_date string, created_at timestamp")
    assert {r.id for r in filters.by_any_date(df, dt.date(2024, 1, 1), dt.date(2024, 1, 31)).collect()} == {1, 2}


# -- competitors -------------------------------------------------------------------------------------------

def brute_competitors(businesses, k, contains):
    out = {}
    for b in businesses:
        hits = [o for o in businesses if o[1] != b[1] and (
            (b[2].lower() in o[2].lower() and b[3].lower() in o[3].lower()) if contains
            else (b[2].lower(), b[3].lower()) == (o[2].lower(), o[3].lower()))]
        hits.sort(key=lambda o: (-(o[4] or 0.0), o[0]))
        out[b[0]] = [o[0] for o in hits[:k]]
    return out


@pytest.mark.parametrize("match", ["equal", "contains"])
def test_competitors_of_a_hot_group_with_a_chain(spark, match):
    rng = random.Random(3)
    names = ["Chain"] * 6 + [f"n{i}" for i in range(8)]
    data = [(f"b{i:03d}", rng.choice(names), rng.choice(["Bar", "bar", "Wine Bar", "Cafe"]), "Rome" if i % 3 else rng.choice(["Rome North", "Oslo"]),
             rng.choice([None, 5.0, 4.5, 4.0, 3.0]), i, 1) for i in range(150)]
    df = spark.createDataFrame(data, "source_id string, name string, category string, city string, rating double, review_count int, price_level int").repartition(5)
    got = {r.business_id: [c.source_id for c in r.competitors] for r in joins.competitors(df, 4, match).collect()}
    assert got == brute_competitors(data, 4, match == "contains")


def test_competitive_position(spark):
    data = [("me", "Me", 4.0, 10), ("a", "A", 3.0, 20), ("b", "B", 5.0, None), ("c", "C", None, 40)]
    df = spark.createDataFrame([(i, n, "Bar", "Rome", r, c, 1) for i, n, r, c in data],
                               "source_id string, name string, category string, city string, rating double, review_count int, price_level int")
    row = aggregates.competitive_position(df).filter("business_id = 'me'").first()
    assert (row.rating_rank, row.total_businesses, row.percentile) == (3, 4, 25.0)
    assert row.avg_competitor_rating == pytest.approx(8 / 3) and row.avg_competitor_reviews == 20.0


def test_keyword_counts_keep_zero(spark):
    reviews = spark.createDataFrame([("Great PIZZA",), ("pizzas",), (None,)], "review_text string")
    keywords = spark.createDataFrame([("pizza",), ("soup",)], "text string")
    assert {r.text: r["count"] for r in joins.keyword_review_counts(keywords, reviews).collect()} == {"pizza": 2, "soup": 0}


@pytest.mark.parametrize("sent", [250_000, 1])
def test_delete_all_sources_deals_no_source_to_one_task(spark, monkeypatch, sent):
    monkeypatch.setattr(maintenance, "SENT_SOURCES", sent)
    monkeypatch.setattr(maintenance, "SOURCE_SHARES", 4)
    rows = [(i, ["a", "b", "c", None][i % 4]) for i in range(400)]
    df = spark.createDataFrame(rows, "no int, source string")
    known = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("z",)], "source string")
    kept = maintenance.delete_all_sources(df, known)
    assert sorted(r.no for r in kept.collect()) == [i for i, s in rows if s in ("c", None)]
    assert sorted(kept.columns) == ["no", "source"]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan if sent > 1 else "__share" in plan


# -- sources -------------------------------------------------------------------------------------------------

def test_page_without_fields_gives_nulls(spark):
    df = spark.createDataFrame([("http://x/biz/a?b=1", "<html><h1>A</h1></html>"), ("http://x/biz/c", "<p>none</p>")], "url string, html string")
    rows = {r.source_id: r for r in pages.extract_business_pages(df).collect()}
    assert rows["a"].name == "A" and rows["c"].name is None
    assert rows["a"].rating is None and rows["a"].hours == {} and rows["a"].images == [] and rows["a"].subcategory is None


def test_southern_and_missing_coordinates(spark):
    html = '<script>mapMarkerProps "latitude":1</script><script>{"mapMarkerProps":{"latitude":-33.5,"longitude":151}}</script>'
    df = spark.createDataFrame([("u", html)], "url string, html string")
    row = pages.extract_business_pages(df).first()
    assert (row.latitude, row.longitude) == (-33.5, 151.0)


def test_broken_json_is_skipped(spark):
    df = spark.createDataFrame([("{broken", "Rome"), ('{"places":[{"id":"p"}]}', "Rome, IT")], "json string, city_query string")
    rows = places.businesses_from_places(df).collect()
    assert [(r.place_id, r.name, r.rating, r.state, r.category) for r in rows] == [("p", "Unknown Business", 4.0, "IT", "Service")]


# -- streams ------------------------------------------------------------------------------------------------------

def test_streams_of_several_batches_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(11)
    data = [(f"r{i % 700}", "s", "hot" if i % 3 == 0 else f"b{i % 7}", dt.datetime(2020, 1, 1) + dt.timedelta(days=rng.randrange(400)),
             rng.randrange(6), rng.random() * 2 - 1, rng.choice(["positive", "negative", "neutral"]), i) for i in range(1000)]
    schema = "source_review_id string, source string, business_id string, review_date timestamp, rating int, sentiment_score double, sentiment_label string, seq int"
    df = spark.createDataFrame(data, schema)
    folder = str(tmp_path / "landed")
    for part in range(4):
        df.filter(F.col("seq") % 4 == part).coalesce(1).write.mode("append").parquet(folder)
    read = lambda: streams.read_stream(spark, folder, "*.parquet", files_per_trigger=1)
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))

    assert same(windows.rating_anomalies(df), streams.rating_anomalies(read()))
    assert same(aggregates.monthly_sentiment(df), streams.monthly_sentiment(read()))
    measures = ["business_id", "total_reviews", "latest_review", "earliest_review"]
    assert same(aggregates.business_analytics(df).select(*measures), streams.business_analytics(read()).select(*measures))


def landed_texts(spark, folder, days):
    """One file per day, in this order of days."""
    for day in days:
        row = [(f"r{day}", f"b{day % 3}", "pizza pasta service", dt.datetime(2024, 1, 1) + dt.timedelta(days=day))]
        spark.createDataFrame(row, "source_review_id string, business_id string, review_text string, review_date timestamp").coalesce(1).write.mode("append").parquet(folder)


def test_late_files_count_and_a_second_call_reads_only_new_ones(spark, tmp_path):
    folder, out = str(tmp_path / "landed"), str(tmp_path / "out")
    landed_texts(spark, folder, [19, 3, 11, 7])
    read = lambda n: streams.read_stream(spark, folder, files_per_trigger=n)
    count = lambda df: df.agg(F.sum("count")).first()[0]
    assert count(streams.trending_keywords(read(1), [])) == count(streams.trending_keywords(read(100), [])) == 4 * 3 * 28
    first = streams.trending_keywords(read(1), [], out)
    assert count(first) == 4 * 3 * 28
    batches = len(os.listdir(f"{out}/parts"))
    assert count(streams.trending_keywords(read(1), [], out)) == 4 * 3 * 28
    assert len(os.listdir(f"{out}/parts")) == batches
    landed_texts(spark, folder, [1])
    assert count(streams.trending_keywords(read(1), [], out)) == 5 * 3 * 28
    assert len(os.listdir(f"{out}/parts")) == batches + 1
    enriched = streams.enrich_reviews(read(1), {"pizza": 1.0}, [], str(tmp_path / "enriched"))
    assert {r.source_review_id for r in enriched.collect()} == {"r19", "r3", "r11", "r7", "r1"}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([("b", 2)], "business_id string, n int")
    for number in (0, 1, 1):
        tables.write_delta(df, str(tmp_path / "parts"), number)
    assert tables.read_deltas(spark, str(tmp_path / "parts"), df.schema).count() == 2
    assert tables.read_deltas(spark, str(tmp_path / "none"), df.schema).count() == 0


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
def test_ingest_takes_the_first_in_order_whenever_it_comes(spark, tmp_path, order):
    folder = str(tmp_path / "landed")
    schema = "source_review_id string, source string, rating int, version int"
    batches = ([("a", "s", 1, 1), ("b", "s", 2, 1)], [("a", "s", 1, 1), ("b", "s", 5, 2)], [("c", "s", 3, 1)])
    for number in order:
        spark.createDataFrame(batches[number], schema).coalesce(1).write.mode("append").parquet(folder)
    got = streams.ingest_dedupe(streams.read_stream(spark, folder, files_per_trigger=1), ["source_review_id", "source"], [F.col("version").desc()])
    assert {(r.source_review_id, r.rating) for r in got.collect()} == {("a", 1), ("b", 5), ("c", 3)}


# -- nothing is cut unless asked for ------------------------------------------------------------------------------

def test_all_words_reviews_and_businesses_count(spark):
    from streetlens.functions import text

    words = " ".join(f"word{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(8))
    df = spark.createDataFrame([(words,)], "review_text string")
    assert df.select(F.size(text.simple_keywords(F.col("review_text")))).first()[0] == 40
    assert df.select(F.size(text.simple_keywords(F.col("review_text"), 15))).first()[0] == 15

    old = [("b", dt.datetime(2019, 1, 1), 1, f"o{i}") for i in range(40)]
    new = [("b", dt.datetime(2020, 1, 1) + dt.timedelta(days=i % 20), 4, f"n{i}") for i in range(600)]
    reviews = spark.createDataFrame(old + new, "business_id string, review_date timestamp, rating int, source_review_id string")
    assert [r.month for r in windows.rating_anomalies(reviews).collect()] == ["2020-01"]
    assert windows.rating_anomalies(reviews, newest=500).count() == 0

    many = spark.createDataFrame([(f"s{i}", f"n{i}", "Bar", "Rome", "a", i, float(i % 5), False) for i in range(1100)],
                                 "source_id string, name string, category string, city string, address string, review_count int, rating double, reviews_fetched boolean")
    of_each = many.select(F.col("source_id").alias("business_id"), F.lit(dt.datetime(2020, 1, 1)).alias("review_date"), F.col("source_id").alias("source_review_id"),
                          F.lit(0.5).alias("sentiment_score"), F.lit("positive").alias("sentiment_label"))
    assert joins.category_reviews(many, of_each, "Bar").count() == 1100
    assert joins.get_reviews(many, of_each, "Bar").count() == 1100 and joins.get_reviews(many, of_each, "Bar", limit=1050).count() == 1050
    assert filters.reviews_pending(many).count() == 1100
    top = aggregates.competitive_position(many).filter("business_id = 's4'").first()
    assert (top.total_businesses, top.rating_rank) == (1100, 881)


def test_measures_cover_all_reviews_and_only_the_array_is_cut(spark):
    b = spark.createDataFrame([("b",), ("empty",)], "source_id string")
    r = spark.createDataFrame([("b", dt.datetime(2020, 1, 1) + dt.timedelta(days=i), f"r{i:02d}", 1.0 if i < 30 else 0.0, "positive") for i in range(40)],
                              "business_id string, review_date timestamp, source_review_id string, sentiment_score double, sentiment_label string")
    rows = {x.source_id: x for x in joins.nest_reviews(b, r, 20).collect()}
    assert (len(rows["b"].reviews), rows["b"].reviews_fetched, rows["b"].avg_sentiment, rows["b"].positive) == (20, 40, 0.75, 40)
    assert (rows["empty"].reviews, rows["empty"].reviews_fetched) == ([], 0)


def test_reviews_of_unknown_businesses_stay(spark):
    r = spark.createDataFrame([("b",), ("x",), ("y",)], "business_id string")
    b = spark.createDataFrame([("b", "B", "Bar", "Rome")], "source_id string, name string, category string, city string")
    assert {(x.business_id, x.business_name) for x in joins.denormalise(r, b).collect()} == {("b", "B"), ("x", None), ("y", None)}


def test_pages_give_all_links_cards_and_images(spark):
    links = "".join(f'<a href="/biz/{i}">x</a>' for i in range(30))
    cards = "".join(f'<div data-cid="{i}"><h3>n{i}</h3></div>' for i in range(25))
    images = "".join(f'<div class="photo-box"><img src="/{i}.jpg"></div>' for i in range(12))
    df = spark.createDataFrame([("u", f"<html>{links}{cards}{images}</html>")], "url string, html string")
    assert pages.extract_links(df).count() == 30 and pages.extract_links(df, limit=20).count() == 20
    assert pages.extract_search_cards(df).count() == 25
    assert len(pages.extract_business_pages(df).first().images) == 12


def test_full_run_keeps_processed_reviews_and_counts_them(spark, tmp_path):
    from streetlens.plans import jobs

    now = dt.datetime(2024, 1, 10)
    rows = [("old", "b", 1, "pizza was bad", dt.datetime(2024, 1, 5), now), ("new", "b", 5, "pizza was good", dt.datetime(2024, 1, 6), None)]
    reviews = spark.createDataFrame(rows, "source_review_id string, business_id string, rating int, review_text string, review_date timestamp, processed_at timestamp")
    businesses = spark.createDataFrame([("b", "B"), ("c", "C")], "source_id string, name string")
    out = jobs.full_run(reviews, businesses, now, {"good": 1.0}, [], out=str(tmp_path / "out"))
    assert {r.source_review_id for r in out["reviews"].collect()} == {"old", "new"}
    stored = {r.source_id: r for r in out["businesses"].collect()}
    assert (stored["b"].analytics.total_reviews, stored["b"].analytics.avg_rating, stored["c"].analytics) == (2, 3.0, None)
    assert {r.text: r["count"] for r in out["trending_keywords"].collect()} == {}
    assert tuple(out["summary"].first())[:2] == (1, 1)


def test_a_search_stores_all_reviews_of_a_business(spark):
    from streetlens import schemas
    from streetlens.plans import jobs

    found = spark.createDataFrame([("p", "B", "Bar", "Rome"), ("q", "C", "Bar", "Rome"), ("q", "D", "Bar", "Rome")], "place_id string, name string, category string, city string")
    rows = [("p", f"r{i:02d}", dt.datetime(2020, 1, 1) + dt.timedelta(days=i)) for i in range(45)] + [("q", "r00", dt.datetime(2021, 1, 1)), ("q", "s", None)]
    landed = spark.createDataFrame(rows, "place_id string, source_review_id string, review_date timestamp")
    none = (spark.createDataFrame([], s) for s in (schemas.BUSINESSES, schemas.REVIEWS))
    businesses, reviews = jobs.store_search(found, landed, *none, dt.datetime(2024, 1, 1))
    stored = {r.source_review_id: (r.business_id, r.business_name) for r in reviews.collect()}
    assert reviews.count() == len(stored) == 46
    assert (stored["r00"], stored["r44"], stored["s"]) == (("q", "C"), ("p", "B"), ("q", "C"))
    assert {(r.source_id, r.reviews_fetched) for r in businesses.collect()} == {("p", True), ("q", True)}
