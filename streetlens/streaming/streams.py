"""Structured Streaming forms of the batch operators.

Every stream runs over what has arrived (``availableNow``) and stops. With a folder given as ``out`` its
checkpoint and its result stay there, and the next call goes on where this one stopped, which is what a
"processed" marker does in a batch job; without one a new folder below the shared folder is used.

A batch writes only what it contributes: sums, counts or rows. Contributions add up in any order, so files
may come in any order, late rows count as well, and no state or watermark is kept. The result is summed up
from the contributions when it is read; once ``FOLD_AFTER`` batches wait, they are folded into one table first, so
that a reader meets one fold and few batches, however many there were.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streetlens.functions import text
from streetlens.functions.arrays import exploded
from streetlens.operators import aggregates, enrich, windows
from streetlens.session import scratch_path
from streetlens.sinks import tables


def read_stream(spark: SparkSession, folder: str, file_pattern: str = "*.parquet", files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files that arrive in a folder, with the schema of those already there."""
    schema = spark.read.option("pathGlobFilter", file_pattern).parquet(folder).schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", file_pattern)
        .option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )


#: Batches that may wait before they are folded.
FOLD_AFTER = 32


def _run(stream: DataFrame, path: str, write: Callable[[DataFrame, int], None]) -> None:
    (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    )


def _contributions(
    stream: DataFrame, name: str, out: str | None, part: Callable[[DataFrame], DataFrame],
    fold: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """What all batches so far contribute, ``part`` of each, including those of earlier calls with ``out``."""
    spark = stream.sparkSession
    path = out or scratch_path(spark, name)
    schema = part(spark.createDataFrame([], stream.schema)).schema
    _run(stream, path, lambda batch, number: tables.write_delta(part(batch), f"{path}/parts", number))
    if fold is not None:
        tables.fold_deltas(spark, f"{path}/parts", schema, fold, FOLD_AFTER)
    return tables.read_deltas(spark, f"{path}/parts", schema)


def _sums(*keys: str, **others: Callable[[str], Column]) -> Callable[[DataFrame], DataFrame]:
    """A fold: sums by key; columns named in ``others`` by another function."""
    def fold(rows: DataFrame) -> DataFrame:
        kinds = dict(rows.dtypes)
        return rows.groupBy(*keys).agg(*[
            others.get(c, F.sum)(c).cast(kinds[c]).alias(c) for c in rows.columns if c not in keys])
    return fold


def enrich_reviews(reviews: DataFrame, lexicon: Mapping[str, float], stop_words: Sequence[str] | None = None, out: str | None = None) -> DataFrame:
    """Enrich each review once, as it arrives."""
    return _contributions(reviews, "enriched", out, lambda batch: enrich.enrich_reviews(batch, lexicon, stop_words=stop_words))


def business_analytics(reviews: DataFrame, out: str | None = None) -> DataFrame:
    """Per-business measures of all reviews that have arrived."""
    fold = _sums("business_id", latest_review=F.max, earliest_review=F.min)
    return aggregates.analytics_of(_contributions(reviews, "analytics", out, aggregates.business_sums, fold))


PANE, SPAN = "6 hours", "7 days"


def keyword_panes(reviews: DataFrame) -> DataFrame:
    """Keyword counts per 6-hour pane: ``pane`` (start), ``keyword``, ``count``."""
    words = exploded(reviews, "keywords", "keyword", "review_date")
    return words.groupBy(F.window("review_date", PANE).alias("w"), "keyword").agg(F.count(F.lit(1)).alias("count")).select(
        F.col("w.start").alias("pane"), "keyword", "count")


def sliding_keywords(panes: DataFrame) -> DataFrame:
    """7-day windows that advance by 6 hours, summed from panes: ``window_start``, ``keyword``, ``count``."""
    whole = panes.groupBy("pane", "keyword").agg(F.sum("count").alias("count"))
    windowed = whole.select(
        F.explode(F.sequence(F.col("pane") - F.expr(f"INTERVAL {SPAN}") + F.expr(f"INTERVAL {PANE}"), "pane", F.expr(f"INTERVAL {PANE}"))).alias("window_start"),
        "keyword", "count")
    return windowed.groupBy("window_start", "keyword").agg(F.sum("count").alias("count"))


def _window_parts(stop_words: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    def part(batch: DataFrame) -> DataFrame:
        keywords = text.keywords(F.col("review_text"), 10, stop_words).alias("keywords")
        return sliding_keywords(keyword_panes(batch.select(F.col("review_date").cast("timestamp").alias("review_date"), keywords)))
    return part


def trending_keywords(reviews: DataFrame, stop_words: Sequence[str], out: str | None = None) -> DataFrame:
    """Sliding keyword counts over all that has arrived; needs ``review_text`` and ``review_date``.

    A batch contributes to the windows that its own rows lie in; a late row adds to its old windows. The 28 windows of
    a row are expanded once, when it arrives.
    """
    counts = _contributions(reviews, "windows", out, _window_parts(stop_words), _sums("window_start", "keyword"))
    return _sums("window_start", "keyword")(counts)


def changed_windows(reviews: DataFrame, stop_words: Sequence[str], out: str) -> DataFrame:
    """``window_start``, ``keyword``, ``count`` of what the rows that arrived since the last call have changed.

    The counts are the new totals; a call without new rows gives none. Only the batches of this call are expanded, and
    only the windows and keywords they touch are looked up in the totals.
    """
    spark, part = reviews.sparkSession, _window_parts(stop_words)
    schema = part(spark.createDataFrame([], reviews.schema)).schema
    new = scratch_path(spark, "changed")

    def write(batch: DataFrame, number: int) -> None:
        tables.write_delta(part(batch), f"{out}/parts", number)
        tables.write_delta(spark.read.schema(schema).parquet(f"{out}/parts/batch={number}").select("window_start", "keyword"), new, number)

    _run(reviews, out, write)
    tables.fold_deltas(spark, f"{out}/parts", schema, _sums("window_start", "keyword"), FOLD_AFTER)
    touched = tables.read_deltas(spark, new, schema.__class__(schema.fields[:2])).distinct()
    totals = tables.read_deltas(spark, f"{out}/parts", schema).join(touched, ["window_start", "keyword"], "left_semi")
    return _sums("window_start", "keyword")(totals)


#: Businesses of a batch that are looked up in the stored sums by a pushed-down list; more of them by a join.
LISTED_BUSINESSES = 1000


def _of_businesses(stored: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows of the touched businesses; of few ones by a filter that reaches the files."""
    ids = [r.business_id for r in touched.limit(LISTED_BUSINESSES + 1).collect()]
    if len(ids) > LISTED_BUSINESSES:
        return stored.join(touched.withColumnRenamed("business_id", "touched_id"), F.col("business_id").eqNullSafe(F.col("touched_id")), "left_semi")
    known = F.col("business_id").isin([i for i in ids if i is not None])
    return stored.filter(known | F.col("business_id").isNull() if None in ids else known)


def rating_anomalies(reviews: DataFrame, out: str | None = None, **kwargs) -> DataFrame:
    """Anomalies over all reviews that have arrived, from sums per business and month.

    A batch adds its monthly sums and looks again at its own businesses alone: of those the stored sums are read (they
    lie sorted by business, so files and row groups of others are skipped) and their anomalies are written anew. The
    result is what was last written of each business; bounds (``kwargs``) hold for the batches they were given with.
    """
    spark = reviews.sparkSession
    path = out or scratch_path(spark, "rating-anomalies")
    sums = _sums("business_id", "month")
    part = windows.monthly_ratings
    schema = part(spark.createDataFrame([], reviews.schema)).schema

    def sorted_sums(rows: DataFrame) -> DataFrame:
        return sums(rows).repartitionByRange("business_id").sortWithinPartitions("business_id", "month")

    def judged(monthly: DataFrame, touched: DataFrame, number: int) -> DataFrame:
        found = windows.anomalies_of(monthly, **kwargs)
        entry = F.struct(*[c for c in found.columns if c != "business_id"])
        nested = found.groupBy("business_id").agg(F.collect_list(entry).alias("anomalies")).withColumnRenamed("business_id", "found_id")
        joined = touched.join(nested, F.col("business_id").eqNullSafe(F.col("found_id")), "left")
        return joined.select("business_id", F.lit(number).cast("bigint").alias("batch_no"), "anomalies")

    none = spark.createDataFrame([], schema)
    judged_schema = judged(none, none.select("business_id"), 0).schema

    def latest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("business_id").agg(F.max("batch_no").alias("batch_no"), F.max_by("anomalies", "batch_no").alias("anomalies"))

    def write(batch: DataFrame, number: int) -> None:
        tables.write_delta(part(batch).sortWithinPartitions("business_id"), f"{path}/parts", number)
        tables.fold_deltas(spark, f"{path}/parts", schema, sorted_sums, FOLD_AFTER)
        added = spark.read.schema(schema).parquet(f"{path}/parts/batch={number}")
        touched = added.select("business_id").distinct()
        stored = tables.read_deltas(spark, f"{path}/parts", schema)
        tables.write_delta(judged(sums(_of_businesses(stored, touched)), touched, number), f"{path}/judged", number)

    _run(reviews, path, write)
    tables.fold_deltas(spark, f"{path}/judged", judged_schema, latest, FOLD_AFTER)
    return latest(tables.read_deltas(spark, f"{path}/judged", judged_schema)).select("business_id", F.inline("anomalies"))


def ingest_dedupe(landed: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str | None = None) -> DataFrame:
    """Landed rows by key, the first in ``order`` of all that have arrived winning, whenever it came.

    A batch stores its own winners; a fold keeps one row of each key, so versions that lost do not stay.
    """
    def winners(rows: DataFrame) -> DataFrame:
        return windows.latest_per_key(rows, keys, order)

    return winners(_contributions(landed, "ingested", out, winners, winners))


def monthly_sentiment(reviews: DataFrame, out: str | None = None) -> DataFrame:
    """Month by label counts of all that has arrived."""
    return _sums("month")(_contributions(reviews, "monthly", out, aggregates.monthly_sentiment, _sums("month")))
