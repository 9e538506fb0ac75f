import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from streetlens.operators import windows

SCHEMA = "business_id string, review_date timestamp, rating int, source_review_id string"


def reviews_of(spark, months, business="b", start=0):
    """``months``: list of (month number, list of ratings)."""
    out, n = [], start
    for month, ratings in months:
        for r in ratings:
            out.append((business, dt.datetime(2020 + (month - 1) // 12, (month - 1) % 12 + 1, 5), r, f"r{n:05d}"))
            n += 1
    return spark.createDataFrame(out, SCHEMA)


def test_gap_months_are_skipped_and_thresholds_are_inclusive(spark):
    # month 2 has only two reviews, so month 3 is compared with month 1: exactly +1.0 is high
    df = reviews_of(spark, [(1, [3, 3, 3, 3]), (2, [5, 5]), (3, [4, 4, 4]), (4, [4, 4, 5, 5])])
    got = {r.month: (r.rating_change, r.type, r.severity) for r in windows.rating_anomalies(df).collect()}
    assert got == {"2020-03": (1.0, "increase", "high"), "2020-04": (0.5, "increase", "medium")}


def test_nine_reviews_give_nothing_and_zero_or_null_ratings_are_dropped(spark):
    nine = reviews_of(spark, [(1, [1, 1, 1]), (2, [5] * 6)])
    assert windows.rating_anomalies(nine).count() == 0
    # ten rows count, but the null and zero ones do not enter the monthly mean
    ten = reviews_of(spark, [(1, [1, 1, 1, 0, None]), (2, [5] * 5)])
    assert [r.rating_change for r in windows.rating_anomalies(ten).collect()] == [4.0]


def test_only_the_newest_reviews_count(spark):
    df = reviews_of(spark, [(1, [1] * 20), (2, [5] * 10), (3, [3] * 10)])
    got = windows.rating_anomalies(df, newest=20).select("month").collect()
    assert [r.month for r in got] == ["2020-03"]


def test_hot_key_gives_the_same_rows_with_and_without_salt(spark):
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.6 else f"b{rng.randrange(5)}", dt.datetime(2020, 1, 1) + dt.timedelta(hours=rng.randrange(5000)),
             rng.randrange(6), f"r{i:05d}") for i in range(4000)]
    df = spark.createDataFrame(data, SCHEMA).repartition(9)
    salted = windows.latest_reviews(df, 50, salts=5)
    plain = windows.latest_reviews(df, 50, salts=1)
    want = defaultdict(list)
    for row in sorted(data, key=lambda r: (r[1], r[3]), reverse=True):
        if len(want[row[0]]) < 50:
            want[row[0]].append(row[3])
    expected = sorted(i for ids in want.values() for i in ids)
    assert sorted(r.source_review_id for r in salted.collect()) == expected
    assert sorted(r.source_review_id for r in plain.collect()) == expected


def test_copies_of_one_row_are_kept_up_to_n(spark):
    copy = ("b", dt.datetime(2020, 1, 1), 3, "same")
    df = spark.createDataFrame([copy] * 300, SCHEMA).repartition(6)
    assert windows.latest_reviews(df, 40).count() == 40


def test_anomaly_records_nest_in_month_order(spark):
    df = reviews_of(spark, [(1, [3] * 4), (2, [5] * 4), (3, [1] * 4)])
    businesses = spark.createDataFrame([("b", "Shop")], "source_id string, name string")
    record = windows.anomaly_records(windows.rating_anomalies(df), businesses, F.lit(dt.datetime(2021, 1, 1))).collect()
    assert len(record) == 1 and record[0].business_name == "Shop"
    assert [(a.month, a.rating_change, a.severity) for a in record[0].anomalies] == [("2020-02", 2.0, "high"), ("2020-03", -4.0, "high")]


def test_percentile_modes(spark):
    df = spark.createDataFrame([("a", "c", 1.0), ("b", "c", 3.0), ("d", "c", 3.0), ("e", "c", None)], "source_id string, category string, rating double")
    reference = {r.source_id: (r.rating_rank, r.percentile) for r in windows.category_percentiles(df).collect()}
    assert reference == {"a": (2, 50.0), "b": (3, 25.0), "d": (3, 25.0), "e": (1, 75.0)}
    corrected = {r.source_id: round(r.percentile, 3) for r in windows.category_percentiles(df, "percent_rank").collect()}
    assert corrected == {"a": 33.333, "b": 66.667, "d": 66.667, "e": 0.0}
