"""Folded contributions, touched businesses and changed windows of the streams."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from streetlens.operators import windows
from streetlens.sinks import tables
from streetlens.streaming import streams

SCHEMA = "business_id string, n long, top long"


def fold(rows):
    return rows.groupBy("business_id").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


def contents(spark, path, schema):
    return sorted(tuple(r) for r in fold(tables.read_deltas(spark, path, schema)).collect())


def test_fifty_batches_a_fold_between_and_a_crash_between_its_steps(spark, tmp_path, monkeypatch):
    path, whole = str(tmp_path / "parts"), {}
    schema = spark.createDataFrame([], SCHEMA).schema

    def add(number):
        rows = [(f"b{(number + i) % 5}", 1 + i, number) for i in range(3)]
        tables.write_delta(spark.createDataFrame(rows, schema).coalesce(1), path, number)
        for b, n, top in rows:
            whole[b] = (b, whole.get(b, (b, 0, 0))[1] + n, max(top, whole.get(b, (b, 0, 0))[2]))

    for number in range(20):
        add(number)
    assert not tables.fold_deltas(spark, path, schema, fold, 20) and tables.fold_deltas(spark, path, schema, fold, 19)
    assert contents(spark, path, schema) == sorted(whole.values())
    before = tables.read_deltas(spark, path, schema)
    for number in range(20, 35):
        add(number)
    with monkeypatch.context() as broken:
        broken.setattr(tables, "remove_folded", lambda *args: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            tables.fold_deltas(spark, path, schema, fold)
    assert contents(spark, path, schema) == sorted(whole.values())
    # frames read before the fold can still be computed
    assert sum(r.n for r in before.collect()) == 20 * 6
    for number in range(35, 50):
        add(number)
    # a batch that a fold holds is replayed
    tables.write_delta(spark.createDataFrame([("b1", 1000, 1000)], schema), path, 34)
    assert contents(spark, path, schema) == sorted(whole.values())
    # a fold that was cut off has no mark of success
    os.makedirs(f"{path}/fold/upto=49")
    assert contents(spark, path, schema) == sorted(whole.values())
    assert tables.fold_deltas(spark, path, schema, fold) and contents(spark, path, schema) == sorted(whole.values())
    assert tables.read_deltas(spark, path, schema).count() == 5
    assert sorted(os.listdir(f"{path}/fold")) == ["upto=34", "upto=49"]
    assert {n for n in os.listdir(path) if n.startswith("batch=")} == {f"batch={i}" for i in range(35, 50)}


REVIEWS = "source_review_id string, source string, business_id string, review_date timestamp, rating int, sentiment_score double, sentiment_label string"


def reviews(spark, rows):
    return spark.createDataFrame(rows, REVIEWS)


def some(seed, n, businesses):
    rng = random.Random(seed)
    return [(f"r{seed}-{i}", "s", rng.choice(businesses), dt.datetime(2020, 1, 1) + dt.timedelta(days=rng.randrange(200)), rng.randrange(6), rng.random(), "neutral")
            for i in range(n)]


def shown(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("after, listed", [(32, 1000), (1, 0)])
def test_anomalies_of_touched_businesses_equal_the_batch_form(spark, tmp_path, monkeypatch, after, listed):
    monkeypatch.setattr(streams, "FOLD_AFTER", after)
    monkeypatch.setattr(streams, "LISTED_BUSINESSES", listed)
    folder, out = str(tmp_path / "landed"), str(tmp_path / "out")
    rows = some(1, 300, ["a", "b", "c", None])
    for part in (rows[200:], rows[:100], rows[100:200]):
        reviews(spark, part).coalesce(1).write.mode("append").parquet(folder)
    read = lambda: streams.read_stream(spark, folder, files_per_trigger=1)
    got = streams.rating_anomalies(read(), out)
    assert shown(got) == shown(windows.rating_anomalies(reviews(spark, rows)).select(got.columns)) and got.count() > 3
    late = some(2, 60, ["b"])
    reviews(spark, late).coalesce(1).write.mode("append").parquet(folder)
    got = streams.rating_anomalies(read(), out)
    assert shown(got) == shown(windows.rating_anomalies(reviews(spark, rows + late)).select(got.columns))
    last = max(int(n.split("=")[1]) for n in os.listdir(f"{out}/judged") if n.startswith("batch="))
    assert [r.business_id for r in spark.read.parquet(f"{out}/judged/batch={last}").collect()] == ["b"]


def test_rows_read_follow_the_touched_businesses(spark, tmp_path):
    stored = spark.range(4000).select(F.format_string("b%04d", F.col("id").cast("int")).alias("business_id"), F.lit("2020-01").alias("month"))
    stored.repartitionByRange(8, "business_id").sortWithinPartitions("business_id").write.parquet(str(tmp_path / "sums"))
    touched = spark.createDataFrame([("b0042",)], "business_id string")
    found = streams._of_businesses(spark.read.parquet(str(tmp_path / "sums")), touched)
    assert found.count() == 1
    frame = found.select("month")
    frame.collect()
    leaf = frame._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert 0 < leaf.metrics().apply("numOutputRows").value() <= 600


def test_a_call_gives_the_windows_it_changed(spark, tmp_path):
    folder, out = str(tmp_path / "landed"), str(tmp_path / "out")

    def land(day, body):
        row = [(f"r{day}", "b", body, dt.datetime(2024, 1, 1) + dt.timedelta(days=day))]
        spark.createDataFrame(row, "source_review_id string, business_id string, review_text string, review_date timestamp").coalesce(1).write.mode("append").parquet(folder)

    read = lambda: streams.read_stream(spark, folder, files_per_trigger=1)
    land(10, "pizza pasta")
    land(2, "pizza")
    first = streams.changed_windows(read(), [], out).collect()
    assert len(first) == 28 * 3 and all(r["count"] == 1 for r in first)
    assert streams.changed_windows(read(), [], out).collect() == []
    land(11, "pizza")
    again = streams.changed_windows(read(), [], out).collect()
    assert {r.keyword for r in again} == {"pizza"} and len(again) == 28
    # those that hold the day before as well
    assert sum(r["count"] == 2 for r in again) == 24
    total = streams.trending_keywords(read(), [], out)
    assert sum(r["count"] for r in total.collect()) == 28 * 4


def test_folded_ingest_keeps_one_row_of_each_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "FOLD_AFTER", 1)
    folder, out = str(tmp_path / "landed"), str(tmp_path / "out")
    schema = "source_review_id string, source string, version int"
    for version in (3, 1, 7, 5):
        spark.createDataFrame([("a", "s", version), (f"x{version}", "s", version)], schema).coalesce(1).write.mode("append").parquet(folder)
        got = streams.ingest_dedupe(streams.read_stream(spark, folder, files_per_trigger=1), ["source_review_id", "source"], [F.col("version").desc()], out)
    assert {(r.source_review_id, r.version) for r in got.collect()} == {("a", 7), ("x3", 3), ("x1", 1), ("x7", 7), ("x5", 5)}
    newest = max(os.listdir(f"{out}/parts/fold"))
    assert spark.read.parquet(f"{out}/parts/fold/{newest}").count() == 5
