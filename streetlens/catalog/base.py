"""Registry of the checkable queries, and the views they read.

A query is a function of :class:`Tables`; its columns are given once as a spec such as
``"source_id rating:d review_count:i"`` and applied to the Spark result and to the SQL alike, so
names, types and rounding are the same on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streetlens.catalog import sql as S
from streetlens.functions import sentiment, text
from streetlens.operators import joins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SPARK = {
    "s": lambda c: F.col(c).cast("string"),
    "i": lambda c: F.col(c).cast("bigint"),
    "d": lambda c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0),
    "b": lambda c: F.col(c).cast("boolean"),
    "t": lambda c: F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss"),
    "l": lambda c: F.array_join(F.col(c), "|"),
}
_DUCK = {
    "s": "CAST({c} AS VARCHAR)", "i": "CAST({c} AS BIGINT)", "d": "round(CAST({c} AS DOUBLE), 6) + 0.0",
    "b": "CAST({c} AS BOOLEAN)", "t": "strftime({c}, '%Y-%m-%d %H:%M:%S')", "l": "array_to_string({c}, '|')",
}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) if ":" in part else (part, "s") for part in spec.split()]


def shaped(df: DataFrame, spec: str) -> DataFrame:
    return df.select(*[_SPARK[kind](name).alias(name) for name, kind in _columns(spec)])


def query(name: str, spec: str, body: str | None = None, views: str = ""):
    """Register a query under ``name``; ``body`` is its SQL over the named views."""
    def add(fn: Callable[["Tables"], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: shaped(fn(Tables(spark, sf_dir)), spec)
        if body is not None:
            inner = f"{S.with_views(views.split())}\n{body.strip()}" if views else body.strip()
            ends = ", ".join(f"{_DUCK[kind].format(c=c)} AS {c}" for c, kind in _columns(spec))
            ORACLES[name] = f"SELECT {ends} FROM (\n{inner}\n) AS result"
        return fn
    return add


class Tables:
    """The given tables and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def businesses(self) -> DataFrame:
        return (
            self.raw("supplier").join(self.raw("nation"), F.expr("s_nationkey = n_nationkey"))
            .join(self.raw("region"), F.expr("n_regionkey = r_regionkey")).selectExpr(*S.BUSINESS_COLUMNS)
        )

    @cached_property
    def more_businesses(self) -> DataFrame:
        """The businesses and one more, of which there is no review."""
        more = self.businesses.filter("source_id = 'biz_5'").withColumn("source_id", F.lit("biz_new"))
        return self.businesses.unionByName(more)

    @cached_property
    def reviews(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(*S.REVIEW_COLUMNS)

    @cached_property
    def named_reviews(self) -> DataFrame:
        """Reviews with name, category and city of their business."""
        return joins.denormalise(self.reviews, self.businesses)

    @cached_property
    def supplier_count(self) -> Column:
        return self.raw("supplier").agg(F.count(F.lit(1))).scalar()

    @cached_property
    def texts(self) -> DataFrame:
        """Documents as reviews with text."""
        n = self.raw("supplier").agg(F.count(F.lit(1)).alias("n"))
        return self.raw("documents").withColumn("n_suppliers", n.scalar()).selectExpr(*S.TEXT_COLUMNS)

    @cached_property
    def scored(self) -> DataFrame:
        """Texts with rating-based sentiment and simple keywords."""
        body, score = F.col("review_text"), F.col("sentiment_score")
        return (
            self.texts.withColumn("sentiment_score", sentiment.rating_keyword_score(F.col("rating"), body))
            .withColumns({
                "sentiment_label": sentiment.label(score, 0.1, inclusive=False),
                "keywords": text.simple_keywords(body),
            })
        )

    @cached_property
    def clicks(self) -> DataFrame:
        """Events as reviews with a time of day."""
        n = self.raw("supplier").agg(F.count(F.lit(1)).alias("n"))
        return self.raw("events").withColumn("n_suppliers", n.scalar()).selectExpr(*S.CLICK_COLUMNS)
