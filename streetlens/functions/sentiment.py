"""Sentiment scores and labels."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from streetlens.constants import NEGATIVE_WORDS, POSITIVE_WORDS
from streetlens.functions.arrays import let
from streetlens.functions.text import cleaned_tokens


def label(score: Column, threshold: float = 0.05, inclusive: bool = True) -> Column:
    """positive / neutral / negative by a symmetric threshold; null gives null."""
    up = score >= threshold if inclusive else score > threshold
    down = score <= -threshold if inclusive else score < -threshold
    return F.when(score.isNull(), F.lit(None).cast("string")).when(up, "positive").when(down, "negative").otherwise("neutral")


def _substring_hits(text: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])


def _rating_base(rating: Column, top: float, step: float) -> Column:
    return (
        F.when(rating >= 4, top + (rating - 4) * step)
        .when(rating >= 3, F.lit(0.0))
        .otherwise(-top + (rating - 1) * step)
    )


def rating_keyword_score(
    rating: Column, text: Column,
    positive: Iterable[str] = POSITIVE_WORDS, negative: Iterable[str] = NEGATIVE_WORDS,
) -> Column:
    """Score from the star rating, moved 0.1 per positive or negative word, clamped to ±1.

    Words count when they occur anywhere, also inside longer words.
    """
    lowered = F.lower(text)
    moved = _rating_base(F.coalesce(rating, F.lit(0)), 0.6, 0.2) + (
        _substring_hits(lowered, positive) - _substring_hits(lowered, negative)
    ) * 0.1
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), moved))


def rating_only_score(rating: Column) -> Column:
    """Score of a review without text."""
    return _rating_base(F.coalesce(rating, F.lit(0)), 0.5, 0.25)


def rating_label(rating: Column) -> Column:
    rating = F.coalesce(rating, F.lit(0))
    return F.when(rating >= 4, "positive").when(rating >= 3, "neutral").otherwise("negative")


def rating_sentiment(rating: Column, text: Column) -> Column:
    """``struct<score, label, confidence, method>`` for a review with or without text."""
    has_text = F.coalesce(F.length(text) > 0, F.lit(False))

    def with_text(score: Column) -> Column:
        return F.struct(
            score.alias("score"),
            label(score, 0.1, inclusive=False).alias("label"),
            F.least(F.lit(0.9), 0.5 + F.abs(score) * 0.5).alias("confidence"),
            F.lit("rating_plus_keywords").alias("method"),
        )

    without_text = F.struct(
        rating_only_score(rating).alias("score"), rating_label(rating).alias("label"),
        F.lit(0.6).alias("confidence"), F.lit("rating_only").alias("method"),
    )
    return F.when(has_text, let(rating_keyword_score(rating, text), with_text)).otherwise(without_text)


def _among(words: list[str]):
    return lambda token: token.isin(words)


def lexicon_sum(tokens: Column, lexicon: Mapping[str, float]) -> Column:
    """``struct<total, hits>`` of the valences of the tokens found in the lexicon.

    Tokens are first cut down to lexicon words by one hash-set test, then counted per valence, so
    the review never leaves its row: no join, no shuffle.
    """
    by_valence = defaultdict(list)
    for word, valence in lexicon.items():
        by_valence[float(valence)].append(word)

    def totals(found: Column) -> Column:
        parts = [
            F.size(F.filter(found, _among(words))) * F.lit(valence)
            for valence, words in sorted(by_valence.items())
        ]
        return F.struct(
            reduce(lambda a, b: a + b, parts).alias("total"), F.size(found).alias("hits")
        )

    return let(F.filter(tokens, lambda t: t.isin(list(lexicon))), totals)


def lexicon_score_of(tokens: Column, lexicon: Mapping[str, float], mode: str = "compound") -> Column:
    """Polarity of cleaned words: ``compound`` = s / sqrt(s^2 + 15), ``mean`` = mean matched valence.

    No matched word gives 0. Negation, boosters and punctuation are not considered.
    """
    def score(found: Column) -> Column:
        if mode == "mean":
            return F.when(found["hits"] > 0, found["total"] / found["hits"]).otherwise(F.lit(0.0))
        return found["total"] / F.sqrt(found["total"] * found["total"] + 15)

    return F.coalesce(let(lexicon_sum(tokens, lexicon), score), F.lit(0.0))


def lexicon_score(text: Column, lexicon: Mapping[str, float], mode: str = "compound") -> Column:
    """Polarity of a text; empty text gives 0."""
    return lexicon_score_of(cleaned_tokens(text), lexicon, mode)
