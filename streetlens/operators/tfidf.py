"""Corpus keyword ranking by TF-IDF over a vocabulary of any size."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetlens.functions.text import default_stop_words
from streetlens.operators.bitmaps import LARGEST_BITS, bit_map
from streetlens.operators.joins import keyword_review_counts
from streetlens.session import stage_table
from streetlens.tasks.terms import frequency_merger, frequency_packer, namer, scorer, weigher

#: Most frequent terms that are sent to every task (20 bytes each), and those of them scored at first.
FREQUENT_TERMS, SCORED_TERMS = 1 << 20, 1 << 16
#: Norms of texts are sent to every task up to so many of them, 16 bytes each.
SENT_NORMS = 2 << 20


class Corpus:
    """Texts, read again for each step; nothing of them is written but what a step finds."""

    def __init__(self, reviews: DataFrame, text_column: str, stops: list[str]):
        body = reviews.filter(F.length(text_column) > 0).select(F.col(text_column).alias("body"))
        self.spark, self.texts, self.stops = reviews.sparkSession, body, stops

    def frequencies(self, with_totals: bool, min_df: int) -> DataFrame:
        """``h``, ``df`` (, ``total``) of the terms in ``min_df`` texts or more: added up in the tasks, then by part of the hashes."""
        names = ["df", "total"] if with_totals else ["df"]
        packed = self.texts.mapInArrow(
            frequency_packer(self.stops, with_totals), ", ".join(["part int", *[f"{c} binary" for c in ["h", *names]]]))
        parts = packed.repartition("part").sortWithinPartitions("part")
        return parts.mapInArrow(frequency_merger(min_df), ", ".join(f"{c} bigint" for c in ["h", *names]))

    def bit_map(self, hashes: DataFrame, count: int):
        """Broadcast bit map of hashes, 16 bits for each up to ``LARGEST_BITS``; bits are set by bucket in the tasks."""
        return bit_map(hashes, count, LARGEST_BITS)

    def named(self, hashes: DataFrame) -> DataFrame:
        """``hashes`` (with a column ``h``) and the ``term`` of each: found in the texts, by a bit map, then by hash.

        Up to ``FREQUENT_TERMS`` hashes are sent themselves, too: a task that has named all reads no more texts for it.
        """
        count = hashes.count()
        wanted = None
        if count <= FREQUENT_TERMS:
            wanted = self.spark.sparkContext.broadcast(np.unique(hashes.select("h").toArrow().column("h").to_numpy()))
        names = self.texts.mapInArrow(namer(self.stops, self.bit_map(hashes, count), wanted), "h bigint, term string")
        return hashes.join(names.groupBy("h").agg(F.min("term").alias("term")), "h")


def _vocabulary(corpus: Corpus, n: int, max_terms: int | None, min_df: int, max_df: float) -> DataFrame:
    """``h``, ``df`` of the kept terms, written."""
    found = corpus.frequencies(max_terms is not None, min_df)
    kept = stage_table(found.filter(F.col("df") <= F.lit(max_df) * n), "tfidf-terms")
    if max_terms is None or kept.count() <= max_terms:
        return kept.select("h", "df")
    cut = kept.orderBy(F.desc("total")).limit(max_terms).agg(F.min("total").alias("cut")).first().cut
    above, ties = kept.filter(F.col("total") > cut), kept.filter(F.col("total") == cut)
    chosen = corpus.named(ties).orderBy("term").limit(max_terms - above.count())
    return stage_table(above.select("h", "df").union(chosen.select("h", "df")), "tfidf-terms")


def _step(df: Column) -> Column:
    """Sixteenths of a power of two: few groups for any frequencies."""
    return F.floor(F.log2(df) * 16).cast("bigint")


def _least_step(kept: DataFrame, most: int) -> int:
    """The lowest step from which on at most ``most`` terms are that frequent."""
    found, total = 1 << 40, 0
    for row in kept.groupBy(_step(F.col("df")).alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():
        total += row.n
        if total > most:
            break
        found = row.step
    return found


def tfidf_keywords(
    reviews: DataFrame, k: int = 50, text_column: str = "review_text",
    stop_words: Iterable[str] | None = None, max_terms: int | None = None, min_df: int = 2, max_df: float = 0.8,
) -> DataFrame:
    """Mean TF-IDF per term over all non-empty texts: columns ``text``, ``weight``.

    Terms are single words and pairs. Kept terms have ``min_df <= df <= max_df * n``; with ``max_terms`` only
    the most frequent of those, A to Z on ties. ``idf = ln((1 + n) / (1 + df)) + 1``; each text's
    weights are scaled to unit length over the kept terms; the score is their sum over ``n``. Scores that agree
    in 12 digits are listed A to Z. An empty table gives no row; null and empty texts do not count.

    No row of (text, term) of a frequent term is ever written or exchanged. Frequencies are added up in the tasks and
    exchanged by the 64-bit hash that stands for a term, those of a part of all hashes in one row. The most frequent terms, a fixed number, are sent to the
    tasks, which weigh them where the text is. Rarer terms that occur in more than one text (a bit map, sized from
    their count, tells them) meet their idf by hash; as they are rare, no hash is hot. As a term's score is at most
    df / n, the k best are among the terms scored first unless the k-th best does not beat that bound; then all
    others are scored too. Only the winners are looked up by name.
    """
    spark = reviews.sparkSession
    corpus = Corpus(reviews, text_column, default_stop_words() if stop_words is None else list(stop_words))
    n = corpus.texts.count()
    kept = _vocabulary(corpus, n, max_terms, min_df, max_df)

    least = _least_step(kept, FREQUENT_TERMS)
    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1
    table = kept.filter(_step(F.col("df")) >= least).select("h", "df", idf.alias("idf")).toArrow().sort_by([("df", "descending"), ("h", "ascending")])
    hashes, df = table.column("h").to_numpy(), table.column("df").to_numpy()
    order = np.argsort(hashes)
    frequent = spark.sparkContext.broadcast((hashes[order], order.astype(np.int32), table.column("idf").to_numpy()))
    rare = kept.filter(_step(F.col("df")) < least)
    rare_bound = rare.agg(F.max("df").alias("df"), F.count(F.lit(1)).alias("n")).first()
    bits = corpus.bit_map(rare, rare_bound.n) if rare_bound.n else None
    rare = rare.select("h", idf.alias("idf"))

    def weighed(scored: int) -> DataFrame:
        """Each text with its norm and the numbers and counts of its first ``scored`` terms."""
        numbered = corpus.texts.select(F.monotonically_increasing_id().alias("text_no"), "body")
        found = numbered.mapInArrow(
            weigher(corpus.stops, frequent, bits, scored),
            "text_no bigint, squares double, numbers array<int>, counts array<int>, rare array<bigint>, rare_counts array<int>")
        if bits is None:
            return found.select("text_no", F.sqrt("squares").alias("norm"), "numbers", "counts", "rare", "rare_counts")
        found = stage_table(found, "tfidf-weights")
        squares = _rare_terms(found).join(rare, "h").groupBy("text_no").agg(F.sum(F.pow(F.col("n") * F.col("idf"), 2)).alias("more"))
        norm = F.sqrt(F.col("squares") + F.coalesce("more", F.lit(0.0)))
        norms = stage_table(found.select("text_no", "squares").join(squares, "text_no", "left").select("text_no", norm.alias("norm")), "tfidf-norms")
        return found.join(F.broadcast(norms) if n <= SENT_NORMS else norms, "text_no").drop("squares")

    def scores(texts: DataFrame, scored: int) -> DataFrame:
        """``h``, ``weight`` of the first ``scored`` terms."""
        sums = texts.select("norm", "numbers", "counts").mapInArrow(scorer(frequent, scored), "number int, weight double")
        got = sums.groupBy("number").agg((F.sum("weight") / n).alias("weight")).toArrow()
        named = pa.table({"h": hashes[got.column("number").to_numpy()], "weight": got.column("weight")})
        return spark.createDataFrame(named, "h bigint, weight double")

    def kth(found: DataFrame) -> float | None:
        best = found.select(F.round("weight", 12).alias("w")).orderBy(F.desc("w")).limit(k).agg(F.min("w").alias("w"), F.count(F.lit(1)).alias("n")).first()
        return best.w if best.n >= k else None

    scored = min(len(hashes), SCORED_TERMS)
    while True:
        texts = weighed(scored)
        found = scores(texts, scored) if scored else spark.createDataFrame([], "h bigint, weight double")
        beyond = df[scored] if scored < len(hashes) else rare_bound.df
        cut = kth(found)
        if beyond is None or cut is not None and cut > beyond / n + 1e-11:
            break
        if scored < len(hashes):
            scored = len(hashes)
            continue
        weight = F.sum(F.col("n") * F.col("idf") / F.col("norm")) / n
        others = _rare_terms(texts, "norm").join(rare, "h").groupBy("h").agg(weight.alias("weight"))
        found = stage_table(found.union(others), "tfidf-scores")
        cut = kth(found)
        break
    for sent in (frequent, bits):
        if sent is not None:
            sent.destroy()
    best = found if cut is None else found.filter(F.round("weight", 12) >= cut)
    named = corpus.named(stage_table(best, "tfidf-best"))
    return named.select(F.col("term").alias("text"), "weight").orderBy(F.round("weight", 12).desc(), "text").limit(k)


def _rare_terms(texts: DataFrame, *others: str) -> DataFrame:
    """One row ``text_no``, ``h``, ``n`` for each term that may be a rarer one of the vocabulary."""
    pairs = F.explode(F.arrays_zip(F.col("rare").alias("h"), F.col("rare_counts").alias("n"))).alias("t")
    return texts.select("text_no", *others, pairs).select("text_no", *others, "t.h", "t.n")


def keyword_cloud(reviews: DataFrame, k: int = 100, text_column: str = "review_text", **kwargs) -> DataFrame:
    """TF-IDF keywords with the number of reviews that contain each: ``text``, ``weight``, ``count``."""
    ranked = stage_table(tfidf_keywords(reviews, k, text_column, **kwargs), "tfidf-ranked")
    return keyword_review_counts(ranked, reviews.filter(F.length(text_column) > 0), text_column)
