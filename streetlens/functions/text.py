"""Text functions: cleaning, tokens, keywords and phrases of one review."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from streetlens.constants import CUSTOM_STOP_WORDS, SHORT_STOP_WORDS
from streetlens.functions.arrays import adjacent_pairs, let, most_common

# White space beyond ASCII, as Unicode text defines it. It is looked for only at characters outside
# ASCII, and plain spaces are left alone: a class of many ranges tested at every character made
# cleaning the most expensive step of every text operator.
_WIDE_SPACE = (
    r"[^\x00-\x7F](?<=[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}])"
)
# Written as single characters: Java tests those by one bit lookup, ranges one by one.
_NARROW = r"\t\n\x0B\f\r\x1C\x1D\x1E\x1F"
# a run of ASCII letters that no other letter, digit or underscore touches
_WORD = r"(?<![\p{{L}}\p{{N}}_])[a-z]{{{n},}}(?![\p{{L}}\p{{N}}_])"


def default_stop_words() -> list[str]:
    """English stop words shipped with Spark plus the review-specific words."""
    english = StopWordsRemover.loadDefaultStopWords("english")
    return sorted(set(english) | set(CUSTOM_STOP_WORDS))


def clean_text(text: Column) -> Column:
    """Lower-case, keep ASCII letters and white space, collapse white space; null gives ''."""
    ascii_spaced = F.regexp_replace(F.lower(text), _WIDE_SPACE, " ")
    letters = F.regexp_replace(ascii_spaced, f"[^a-z {_NARROW}]+", "")
    single = F.regexp_replace(letters, f"[ {_NARROW}]{{2,}}|[{_NARROW}]", " ")
    return F.coalesce(F.trim(single), F.lit(""))


def cleaned_tokens(text: Column) -> Column:
    """Words of the cleaned text, in order."""
    return F.filter(F.split(clean_text(text), " "), lambda t: t != "")


def _is_stop(token: Column, stop_words: Iterable[str]) -> Column:
    return token.isin(list(stop_words))


def _stops(stop_words: Iterable[str] | None) -> list[str]:
    return default_stop_words() if stop_words is None else list(stop_words)


def keyword_tokens(tokens: Column, stop_words: Iterable[str], min_length: int = 3) -> Column:
    """Cleaned words without stop words and short words."""
    return F.filter(tokens, lambda t: (F.length(t) >= min_length) & ~_is_stop(t, stop_words))


def keywords_of(tokens: Column, k: int = 10, stop_words: Iterable[str] | None = None) -> Column:
    """The ``k`` most frequent keywords among the cleaned words of a review."""
    return most_common(keyword_tokens(tokens, _stops(stop_words)), k)


def keywords(text: Column, k: int = 10, stop_words: Iterable[str] | None = None) -> Column:
    """The ``k`` most frequent keywords of a review."""
    return keywords_of(cleaned_tokens(text), k, stop_words)


def phrase_tokens(tokens: Column, stop_words: Iterable[str], min_length: int = 6) -> Column:
    """Pairs of neighbouring cleaned words, neither a stop word, joined by a space."""
    kept = F.filter(
        adjacent_pairs(tokens),
        lambda p: ~_is_stop(p["a"], stop_words) & ~_is_stop(p["b"], stop_words)
        & (F.length(p["a"]) + F.length(p["b"]) + 1 >= min_length),
    )
    return F.transform(kept, lambda p: F.concat_ws(" ", p["a"], p["b"]))


def phrases_of(tokens: Column, k: int = 5, stop_words: Iterable[str] | None = None) -> Column:
    """The ``k`` most frequent phrases among the cleaned words of a review."""
    return most_common(phrase_tokens(tokens, _stops(stop_words)), k)


def phrases(text: Column, k: int = 5, stop_words: Iterable[str] | None = None) -> Column:
    """The ``k`` most frequent phrases of a review."""
    return phrases_of(cleaned_tokens(text), k, stop_words)


def simple_words(text: Column, stop_words: Iterable[str] = SHORT_STOP_WORDS, min_length: int = 4) -> Column:
    """Whole ASCII words of a text in order of appearance, without stop words and short words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(_WORD.format(n=min_length)), F.lit(0))
    return F.filter(words, lambda w: ~_is_stop(w, stop_words))


def simple_keywords(
    text: Column, k: int | None = None, stop_words: Iterable[str] = SHORT_STOP_WORDS, min_length: int = 4
) -> Column:
    """The different simple words of a text in order of appearance; the first ``k`` when given."""
    words = F.array_distinct(simple_words(text, stop_words, min_length))
    return words if k is None else F.slice(words, 1, k)


def word_count(text: Column) -> Column:
    """Number of words between white space."""
    words = F.split(F.regexp_replace(text, _WIDE_SPACE, " "), f"[ {_NARROW}]+")
    return F.size(F.filter(words, lambda w: w != ""))


def character_count(text: Column) -> Column:
    return F.length(text)


def ngram_tokens(text: Column, stop_words: Iterable[str]) -> Column:
    """Single words (two letters or more, no stop words) followed by the pairs of what is left.

    Stop words are removed before pairing, so a pair may bridge a removed word.
    """
    words = keyword_tokens(cleaned_tokens(text), stop_words, min_length=2)
    return let(
        words,
        lambda w: F.concat(w, F.transform(adjacent_pairs(w), lambda p: F.concat_ws(" ", p["a"], p["b"]))),
    )
