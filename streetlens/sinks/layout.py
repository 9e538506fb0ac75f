"""Tables laid out for deletes and upserts: folders by a column, buckets by the key."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from streetlens.operators.windows import latest_per_key
from streetlens.sinks import maintenance

_FOLDER = "__folder"
_KEY = "row_key"

# -- folders -----------------------------------------------------------------------------------------


def month_of(column: str) -> Column:
    """Month as ``yyyy-MM``, whose order is that of time; null for an undated row."""
    return F.date_format(column, "yyyy-MM")


def write_folders(df: DataFrame, path: str, by: str) -> DataFrame:
    """Write a table with one folder for each value of ``by``; null has its own."""
    df.write.partitionBy(by).parquet(path)
    return read_folders(df.sparkSession, path, df.schema)


def read_folders(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*[F.col(f"`{name}`") for name in schema.fieldNames()])


def keep_rows(
    spark: SparkSession, path: str, schema: StructType, by: str, keep: Callable[[DataFrame], DataFrame], within: Column | None = None,
) -> DataFrame:
    """Reduce a table of folders to what ``keep`` leaves, and read it again.

    ``keep`` takes rows and returns those that stay, with all their columns. Folders that lose no row are not
    touched, those that lose all are removed, the others are written anew by dynamic partition overwrite.
    ``within`` is a condition on ``by`` alone, outside of which nothing is deleted: such folders are not even read.
    What goes to the driver is one row for each folder that loses rows. No row is exchanged but by ``keep``.

    Running it again after a failure before the swap deletes the same rows; the swap itself is that of Spark's
    committer (a folder is removed, then its successor renamed), so keep a copy where that is not enough.
    """
    table = read_folders(spark, path, schema)
    if within is not None:
        table = table.filter(within)
    placed = table.withColumn(_FOLDER, F.regexp_replace("_metadata.file_path", "/[^/]*$", ""))
    before = placed.groupBy(_FOLDER, by).agg(F.count(F.lit(1)).alias("before"))
    after = keep(placed).groupBy(_FOLDER).agg(F.count(F.lit(1)).alias("after"))
    left = F.coalesce("after", F.lit(0))
    touched = before.join(after, _FOLDER, "left").filter(left < F.col("before")).select(_FOLDER, by, left.alias("after")).collect()
    values = [row[by] for row in touched if row.after]
    if values:
        named = F.col(by).isin([v for v in values if v is not None])
        part = table.filter(named | F.col(by).isNull() if None in values else named)
        keep(part).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(by).parquet(path)
    for row in touched:
        if not row.after:
            _remove(spark, row[_FOLDER])
    return read_folders(spark, path, schema)


def _remove(spark: SparkSession, uri: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def delete_source(spark: SparkSession, path: str, schema: StructType, source: str) -> DataFrame:
    """``delete_by_source`` on a table with folders by source: one folder is removed, no row is read."""
    return keep_rows(spark, path, schema, "source", lambda df: maintenance.delete_by_source(df, source), F.col("source") == source)


def delete_business_city(
    spark: SparkSession, path: str, schema: StructType, by: str, city: str, address_too: bool = True, literal: bool = False,
) -> DataFrame:
    """``delete_businesses_by_city`` on a table with folders by any column."""
    return keep_rows(spark, path, schema, by, lambda df: maintenance.delete_businesses_by_city(df, city, address_too, literal))


def delete_review_city(
    spark: SparkSession, path: str, schema: StructType, by: str, businesses: DataFrame, city: str, address_too: bool = True, literal: bool = False,
) -> DataFrame:
    """``delete_reviews_by_city`` on a table with folders by any column; ``businesses`` are those before the delete."""
    return keep_rows(spark, path, schema, by, lambda df: maintenance.delete_reviews_by_city(businesses, df, city, address_too, literal))


def retention(
    spark: SparkSession, path: str, schema: StructType, as_of: dt.datetime, days: int = 90, column: str = "generated_at", by: str = "month",
) -> DataFrame:
    """``retention_cleanup`` on a table with folders by month of ``column`` (:func:`month_of`).

    Months before that of the limit go, the month of the limit is written anew, later months and undated rows
    are not read.
    """
    limit = (as_of - dt.timedelta(days=days)).strftime("%Y-%m")
    return keep_rows(spark, path, schema, by, lambda df: maintenance.retention_cleanup(df, as_of, days, column), F.col(by) <= limit)


# -- buckets -----------------------------------------------------------------------------------------


def row_key(keys: Sequence[str]) -> Column:
    """One string for the key; differs wherever a field differs, null and empty included."""
    return F.to_json(F.struct(*keys))


def write_buckets(df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """Save a table in buckets by its key (the column ``row_key`` is added). Choose ``buckets`` for some 1 GB each."""
    writer = df.withColumn(_KEY, row_key(keys)).write.bucketBy(buckets, _KEY).sortBy(_KEY)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def upsert_buckets(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """:func:`upsert.upsert` for a table of :func:`write_buckets`: the same rows, ``row_key`` included.

    The batch alone is exchanged, into the buckets of the table, and one full join overlays and inserts in one
    reading of it. ``target`` holds each key once. Save the result as the table's next version, in as many buckets.
    """
    winners = latest_per_key(batch.withColumn(_KEY, row_key(keys)), [_KEY], order)
    columns = target.columns
    joined = target.alias("t").join(winners.withColumn("__hit", F.lit(True)).alias("u"), F.col(f"t.{_KEY}") == F.col(f"u.{_KEY}"), "full")
    hit = F.col("u.__hit").isNotNull()

    def value(name: str) -> Column:
        if name not in winners.columns:
            return F.col(f"t.`{name}`")
        if name not in columns:
            return F.col(f"u.`{name}`")
        return F.when(hit, F.col(f"u.`{name}`")).otherwise(F.col(f"t.`{name}`"))

    extra = [c for c in winners.columns if c not in columns]
    return joined.select(*[value(c).alias(c) for c in [*columns, *extra]])
