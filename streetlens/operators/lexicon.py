"""Word tables joined to texts: sentiment with a lexicon and keywords with a stop list, both of any size."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetlens.functions.arrays import adjacent_pairs, exploded, occurrence_counts
from streetlens.functions.text import cleaned_tokens
from streetlens.operators.bitmaps import bit_map
from streetlens.operators.tfidf import _least_step as least_step, _step as frequency_step
from streetlens.session import stage_table
from streetlens.tasks.terms import HashedWords, by_chunks, scored, scored_with_rest, word_counter, word_hasher

#: A word table is sent to every task up to so many words and bytes of them.
SENT_WORDS, SENT_BYTES = 250_000, 8 << 20
#: As sorted 64-bit hashes words are sent up to so many bytes: 8 each, and 8 for a value.
SENT_HASH_BYTES = 96 << 20


def word_table(words: DataFrame, word_column: str = "word", value_column: str | None = None) -> DataFrame:
    """One row ``word`` (, ``value``) for each word; null words and values drop out, of a repeated word the mean.

    Written once: its size is asked for before it is joined.
    """
    known = words.filter(F.col(word_column).isNotNull()).select(
        F.col(word_column).alias("word"), *([F.col(value_column).cast("double").alias("value")] if value_column else []))
    if value_column:
        return stage_table(known.filter(F.col("value").isNotNull()).groupBy("word").agg(F.avg("value").alias("value")), "lexicon")
    return stage_table(known.distinct(), "stop-words")


def _is_small(table: DataFrame) -> bool:
    size = table.limit(SENT_WORDS + 1).agg(F.count(F.lit(1)).alias("words"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("bytes")).first()
    return size.words <= SENT_WORDS and size.bytes <= SENT_BYTES


def _joinable(table: DataFrame) -> DataFrame:
    """Sent to every task behind a check of its size; beyond it both sides are dealt by word."""
    return F.broadcast(table) if _is_small(table) else table


def _sent(table: DataFrame) -> HashedWords:
    """``h`` (, ``value``) of a bounded number of words, broadcast."""
    got = table.toArrow()
    hashes = got.column("h").to_numpy()
    order = np.argsort(hashes)
    values = got.column("value").to_numpy()[order] if "value" in got.column_names else None
    return HashedWords(table.sparkSession.sparkContext.broadcast((hashes[order], values)))


def _hashed(table: DataFrame) -> DataFrame:
    return table.mapInArrow(word_hasher, "h bigint, value double" if "value" in table.columns else "h bigint")


def hashed_words(table: DataFrame) -> HashedWords | None:
    """A written table of words as what is sent to the tasks; None if it is too large for that.

    Words whose 64-bit hashes collide would be taken for one: expected in some 8 of ten million tables of that size.
    """
    most = SENT_HASH_BYTES // (16 if "value" in table.columns else 8)
    return None if table.limit(most + 1).count() > most else _sent(_hashed(table))


def _keyed(reviews: DataFrame, key: Sequence[str], text_column: str) -> DataFrame:
    """``key`` (struct of the key and a hash of the text), ``body``."""
    return reviews.select(
        F.struct(*key, F.xxhash64(text_column).alias("text_hash")).alias("key"), F.col(text_column).alias("body"))


def _unkeyed(rows: DataFrame, key: Sequence[str], *results: str) -> DataFrame:
    return rows.select(*[F.col("key")[k].alias(k) for k in key], F.col("key")["text_hash"].alias("text_hash"), *results)


def lexicon_totals(reviews: DataFrame, lexicon: DataFrame, key: Sequence[str], text_column: str = "review_text") -> DataFrame:
    """``key`` columns, ``text_hash``, ``total`` (valences of all matched words), ``hits`` (how many) of each review.

    ``lexicon`` has ``word`` and ``value``, each word once, and is written. Up to ``SENT_HASH_BYTES`` it is sent to the
    tasks as hashes; the words of a text are summed up where it is, and only (key, total, hits) is exchanged. Of a larger
    one the words that are most frequent in the texts are sent; the others, told by a bit map, meet their values by hash
    with their counts, and as they are rare, no hash is hot. Reviews without a matched word have zeros. Reviews that
    share the key and the text are one row.
    """
    keyed = _keyed(reviews, key, text_column)
    sent = hashed_words(lexicon)
    if sent:
        counted = F.arrow_udf(by_chunks(scored, sent), "total double, hits bigint")
        found = keyed.select("key", counted(F.col("body")).alias("found"))
        sums = found.groupBy("key").agg(*[F.max(f"found.{c}").alias(c) for c in ("total", "hits")])
        return _unkeyed(sums, key, "total", "hits")
    used = keyed.select("body").mapInArrow(word_counter, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("df"))
    used = stage_table(_hashed(lexicon).join(used, "h"), "lexicon-used")
    least = least_step(used, SENT_HASH_BYTES // 16)
    rare = used.filter(frequency_step(F.col("df")) < least).select("h", "value")
    sent, bits = _sent(used.filter(frequency_step(F.col("df")) >= least).select("h", "value")), bit_map(rare.select("h"), rare.count())
    counted = F.arrow_udf(by_chunks(scored_with_rest, sent, bits), "total double, hits bigint, rest array<bigint>, counts array<bigint>")
    found = stage_table(keyed.select("key", counted(F.col("body")).alias("found")).select("key", "found.*"), "lexicon-found")
    words = exploded(found, F.arrays_zip("rest", "counts"), "t", "key").select("key", F.col("t.rest").alias("h"), F.col("t.counts").alias("n"))
    zero = F.lit(0).cast("bigint")
    parts = words.join(rare, "h").select("key", (F.col("n") * F.col("value")).alias("total"), F.col("n").alias("hits"), zero.alias("copies"))
    parts = parts.union(found.select("key", "total", "hits", F.lit(1).cast("bigint")))
    sums = parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("total", "hits", "copies")])
    # equal rows were added up once each
    return _unkeyed(sums.select(
        "key", (F.col("total") / F.col("copies")).alias("total"), (F.col("hits") / F.col("copies")).cast("bigint").alias("hits")), key, "total", "hits")


def polarity(total: Column, hits: Column, mode: str = "compound") -> Column:
    """``compound`` = s / sqrt(s² + 15), ``mean`` = mean matched valence; no matched word gives 0."""
    if mode == "mean":
        return F.when(hits > 0, total / hits).otherwise(F.lit(0.0))
    if mode != "compound":
        raise ValueError(f"unknown mode {mode!r}")
    return total / F.sqrt(total * total + 15)


def lexicon_scores(
    reviews: DataFrame, lexicon: DataFrame, key: Sequence[str] = ("review_id",), text_column: str = "review_text",
    mode: str = "compound", word_column: str = "word", value_column: str = "valence",
) -> DataFrame:
    """``key`` columns and ``score`` of each review by a lexicon that is a table of words and valences.

    The plan does not depend on the words: a lexicon of any size works, a small one is sent to the tasks. Null and
    empty texts score 0; a null word or valence is ignored, a repeated word has its mean valence; reviews of one key
    with different texts have a row each. Negation, boosters and punctuation are not considered.
    """
    totals = lexicon_totals(reviews, word_table(lexicon, word_column, value_column), key, text_column)
    return totals.select(*key, polarity(F.col("total"), F.col("hits"), mode).alias("score"))


def _ranked(k: int) -> Column:
    # a set, as equal rows of a key and text count a word once
    best = F.sort_array(F.collect_set(F.struct((-F.col("n")).alias("neg"), "first", "term")))
    return F.transform(F.slice(best, 1, k), lambda t: t["term"])


def table_keywords(
    reviews: DataFrame, stop_words: DataFrame, key: Sequence[str] = ("review_id",), text_column: str = "review_text",
    k: int = 10, min_length: int = 3, word_column: str = "word",
) -> DataFrame:
    """``key`` columns, ``text_hash`` and ``keywords``: the ``k`` most frequent words that are not in a stop table.

    As ``functions.text.keywords``, with the stop list as a table of any size. Reviews without a keyword have no row.
    """
    stops = _joinable(word_table(stop_words, word_column))
    counted = _keyed(reviews, key, text_column).select("key", occurrence_counts(cleaned_tokens(F.col("body"))).alias("terms"))
    words = exploded(counted, "terms", "t", "key").select("key", "t.term", "t.n", "t.first").filter(F.length("term") >= min_length)
    kept = words.join(stops.withColumnRenamed("word", "term"), "term", "left_anti")
    return _unkeyed(kept.groupBy("key").agg(_ranked(k).alias("keywords")), key, "keywords")


def table_phrases(
    reviews: DataFrame, stop_words: DataFrame, key: Sequence[str] = ("review_id",), text_column: str = "review_text",
    k: int = 5, min_length: int = 6, word_column: str = "word",
) -> DataFrame:
    """``key`` columns, ``text_hash`` and ``phrases``: the ``k`` most frequent neighbours, neither in a stop table.

    As ``functions.text.phrases``, with the stop list as a table of any size. Reviews without a phrase have no row.
    """
    stops = _joinable(word_table(stop_words, word_column))
    pairs = F.transform(adjacent_pairs(cleaned_tokens(F.col("body"))), lambda p: F.concat_ws(" ", p["a"], p["b"]))
    counted = _keyed(reviews, key, text_column).select("key", occurrence_counts(pairs).alias("terms"))
    rows = exploded(counted, "terms", "t", "key").select("key", "t.term", "t.n", "t.first").filter(F.length("term") >= min_length)
    rows = rows.withColumns({"a": F.substring_index("term", " ", 1), "b": F.substring_index("term", " ", -1)})
    for side in ("a", "b"):
        rows = rows.join(stops.withColumnRenamed("word", side), side, "left_anti")
    return _unkeyed(rows.groupBy("key").agg(_ranked(k).alias("phrases")), key, "phrases")
