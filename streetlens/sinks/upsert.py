"""Upserts and partial updates as joins; the result is the table's new state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetlens.operators.windows import latest_per_key

_KEY = "__key"


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the keys as one struct column: equal also where a field is null, and one partitioning that
    the ranking of the batch and the joins share."""
    return df.withColumn(_KEY, F.struct(*keys))


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """New state of ``target`` after upserting ``batch`` by ``keys``.

    Only the columns that the batch supplies are overlaid (supplied nulls overwrite), unmatched rows
    are inserted, and of several batch rows with one key the first in ``order`` wins. Columns used
    only for ``order`` should be dropped by the caller if the table must not have them.

    A left join for the overlay and an anti join for the inserts, instead of one full outer join:
    both let Spark broadcast a small batch, so the large table is not shuffled, and both may be split
    on a hot key.
    """
    held = _keyed(target, keys)
    winners = latest_per_key(_keyed(batch, keys), [_KEY], order)
    present = held.select(_KEY).join(winners.select(_KEY), _KEY, "left_semi")
    fresh = winners.join(present, _KEY, "left_anti").drop(_KEY)
    return _overlay(held, winners.drop(*keys)).unionByName(fresh, allowMissingColumns=True)


def update_columns(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overlay the columns of ``changes`` on matching rows; nothing is inserted.

    ``changes`` holds one row per key.
    """
    return _overlay(_keyed(target, keys), _keyed(changes, keys).drop(*keys))


def _overlay(held: DataFrame, changes: DataFrame) -> DataFrame:
    columns = [c for c in held.columns if c != _KEY]
    supplied = [c for c in changes.columns if c != _KEY]
    joined = held.alias("t").join(changes.withColumn("__hit", F.lit(True)).alias("u"), _KEY, "left")
    hit = F.coalesce("u.__hit", F.lit(False))

    def value(name: str) -> Column:
        if name not in supplied:
            return F.col(f"t.{name}")
        if name not in columns:
            return F.col(f"u.{name}")
        return F.when(hit, F.col(f"u.{name}")).otherwise(F.col(f"t.{name}"))

    extra = [c for c in supplied if c not in columns]
    return joined.select(*[value(c).alias(c) for c in [*columns, *extra]])


BUSINESS_KEY = ("source_id", "source")
PLACE_KEY = ("place_id",)
REVIEW_KEY = ("source_review_id", "source")
EVENT_KEY = ("source_id", "source")
ANOMALY_KEY = ("business_id",)


def upsert_businesses(target: DataFrame, batch: DataFrame, order: Sequence[Column]) -> DataFrame:
    return upsert(target, batch, BUSINESS_KEY, order)


def upsert_businesses_by_place(target: DataFrame, batch: DataFrame, order: Sequence[Column]) -> DataFrame:
    return upsert(target, batch, PLACE_KEY, order)


def upsert_reviews(target: DataFrame, batch: DataFrame, order: Sequence[Column]) -> DataFrame:
    return upsert(target, batch, REVIEW_KEY, order)


def upsert_events(target: DataFrame, batch: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Events by (source_id, source), with a ``location`` point from usable coordinates."""
    from streetlens.functions.scalars import point

    located = batch.withColumn("location", point(F.col("longitude"), F.col("latitude")))
    return upsert(target, located, EVENT_KEY, order)


def upsert_anomalies(target: DataFrame, records: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Anomaly records by business, only those with anomalies."""
    return upsert(target, records.filter(F.size("anomalies") > 0), ANOMALY_KEY, order)
