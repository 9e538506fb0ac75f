import datetime as dt
import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from streetlens.sinks import layout, maintenance, upsert

AS_OF = dt.datetime(2024, 6, 30)


def files(path):
    return {name: os.stat(name).st_mtime_ns for name in glob.glob(f"{path}/*/*.parquet")}


def content(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.fixture
def dated(spark):
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=d) for d in range(180)]
    rows = [(i, f"s{i % 3}", day, "x") for i, day in enumerate(days)] + [(900, None, None, "x"), (901, "s 1/%", dt.datetime(2024, 4, 1), None)]
    return spark.createDataFrame(rows, "id int, source string, generated_at timestamp, `a.b` string").withColumn("month", layout.month_of("generated_at"))


def test_retention_leaves_later_months_and_undated_rows_alone(spark, dated, tmp_path):
    path = str(tmp_path / "t")
    layout.write_folders(dated.repartition(3), path, "month")
    before = files(path)
    left = layout.retention(spark, path, dated.schema, AS_OF)
    assert content(left) == content(maintenance.retention_cleanup(dated, AS_OF))
    # the limit is 2024-04-01 00:00, of which the rows stay: no month is cut, three go
    now = files(path)
    assert now == {n: t for n, t in before.items() if not re.search("month=2024-0[123]", n)}
    again = layout.retention(spark, path, dated.schema, AS_OF + dt.timedelta(days=10))
    assert content(again) == content(maintenance.retention_cleanup(dated, AS_OF + dt.timedelta(days=10)))
    later = {n: t for n, t in files(path).items() if "month=2024-04" not in n}
    assert later and later == {n: t for n, t in now.items() if "month=2024-04" not in n}


def test_a_source_is_one_folder(spark, dated, tmp_path):
    path = str(tmp_path / "t")
    layout.write_folders(dated, path, "source")
    before = files(path)
    for source in ("s 1/%", "s1", "never seen"):
        left = layout.delete_source(spark, path, dated.schema, source)
    assert content(left) == content(dated.filter("source IS NULL OR source NOT IN ('s 1/%', 's1')"))
    after = files(path)
    assert set(after.items()) < set(before.items()) and len({os.path.dirname(n) for n in after}) == 3


def test_cities_with_and_without_a_hit(spark, tmp_path):
    b = spark.createDataFrame(
        [("1", "Shop", "Rome", "x", "s1"), ("2", "Bar", None, "Via Roma, Rome", None), ("3", None, "Oslo", None, "s2"), ("4", "Inn", "Oslo", None, None)],
        "source_id string, name string, city string, address string, source string")
    path = str(tmp_path / "b")
    layout.write_folders(b.coalesce(1), path, "source")
    before = files(path)
    left = layout.delete_business_city(spark, path, b.schema, "source", "rome")
    assert content(left) == content(maintenance.delete_businesses_by_city(b, "rome"))
    after = files(path)
    assert {n: t for n, t in before.items() if "source=s2" in n}.items() <= after.items() and not any("source=s1" in n for n in after)
    r = spark.createDataFrame([("Shop", "Oslo"), ("Bar", None), ("Pub", "Rome"), (None, None), ("Inn", "Oslo")], "business_name string, business_city string")
    path = str(tmp_path / "r")
    layout.write_folders(r, path, "business_city")
    left = layout.delete_review_city(spark, path, r.schema, "business_city", b, "rome")
    assert content(left) == content(maintenance.delete_reviews_by_city(b, r, "rome"))


def test_an_empty_table_stays_empty(spark, dated, tmp_path):
    path = str(tmp_path / "t")
    layout.write_folders(dated.filter("id < 5"), path, "month")
    assert layout.retention(spark, path, dated.schema, AS_OF).count() == 0
    assert layout.retention(spark, path, dated.schema, AS_OF).count() == 0


def test_a_bucketed_target_is_not_exchanged(spark, tmp_path):
    keys = ["k", "source"]
    target = spark.createDataFrame([("a", "x", 1, "keep"), ("b", "x", 2, "keep"), (None, "x", 3, "keep"), ("", "x", 4, "keep")], "k string, source string, v int, other string")
    batch = spark.createDataFrame(
        [("a", "x", 10, 1), ("a", "x", None, 2), ("c", "x", 7, 1), (None, "x", 9, 1), ("x", None, 5, 1)], "k string, source string, v int, seq int")
    order = [F.col("seq").desc()]
    held = layout.write_buckets(target, "upsert_buckets_v0", keys, 4, str(tmp_path / "v0"))
    once = layout.upsert_buckets(held, batch, keys, order)
    assert content(once.drop("row_key")) == content(upsert.upsert(target, batch, keys, order).select(*once.drop("row_key").columns))
    plan = once._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("FileScan")].splitlines()
    side = next(i for i, line in enumerate(above) if "SortMergeJoin" in line)
    assert "SelectedBucketsCount: 4 out of 4" in plan and not any("Exchange" in line for line in above[side:])
    # the next version is a table of the same kind
    nxt = layout.write_buckets(once.drop("row_key", "seq"), "upsert_buckets_v1", keys, 4, str(tmp_path / "v1"))
    again = layout.upsert_buckets(nxt, batch, keys, order).drop("row_key", "seq")
    assert content(again) == content(once.drop("row_key", "seq"))
    spark.sql("DROP TABLE upsert_buckets_v0")
    spark.sql("DROP TABLE upsert_buckets_v1")
