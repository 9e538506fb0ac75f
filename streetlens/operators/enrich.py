"""Enrichment of review rows: sentiment, keywords, phrases, counts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetlens.functions import sentiment, text
from streetlens.operators.lexicon import hashed_words, lexicon_totals, polarity, table_keywords, table_phrases, word_table
from streetlens.tasks.terms import Words, by_chunks, enriched

_FOUND = "total double, hits bigint, keywords array<string>, phrases array<string>"
ENRICHED = ("sentiment_score", "sentiment_label", "keywords", "phrases", "word_count", "character_count")


def enrich_reviews(
    reviews: DataFrame, lexicon: Mapping[str, float] | None = None, text_column: str = "review_text",
    stop_words: Iterable[str] | None = None, score_fn: Callable[[Column], Column] | None = None,
    mode: str = "compound", max_keywords: int = 10, max_phrases: int = 5,
) -> DataFrame:
    """Add score, label, keywords, phrases and counts; rows without text get nulls.

    ``score_fn`` may be any column function of the text, for instance a pandas UDF wrapping a
    scorer of the user; without it the score comes from ``lexicon``.
    """
    if score_fn is None and lexicon is None:
        raise ValueError("give a lexicon or a score_fn")
    body = F.col(text_column)
    stops = text.default_stop_words() if stop_words is None else list(stop_words)
    has_text = F.coalesce(F.length(body) > 0, F.lit(False))
    threshold, inclusive = (0.05, True) if mode == "compound" else (0.1, False)
    found = F.col("__found")
    # the words are cleaned and counted once, on Arrow batches, for the score, the keywords and the phrases
    valences = {} if score_fn or lexicon is None else {word: float(v) for word, v in lexicon.items()}
    counted = F.arrow_udf(
        by_chunks(enriched, Words(stops), Words(list(valences), list(valences.values())), max_keywords, max_phrases), _FOUND)
    score = score_fn(body) if score_fn else polarity(found["total"], found["hits"], "mean" if mode == "mean" else "compound")

    def where_text(value: Column) -> Column:
        return F.when(has_text, value)

    return reviews.withColumn("__found", counted(body)).withColumns({
        "sentiment_score": where_text(score),
        "keywords": where_text(found["keywords"]),
        "phrases": where_text(found["phrases"]),
        "word_count": where_text(text.word_count(body)),
        "character_count": where_text(text.character_count(body)),
    }).drop("__found").withColumn("sentiment_label", sentiment.label(F.col("sentiment_score"), threshold, inclusive))


def enrich_with_tables(
    reviews: DataFrame, lexicon: DataFrame, stop_words: DataFrame, key: Sequence[str] = ("review_id",), text_column: str = "review_text",
    mode: str = "compound", max_keywords: int = 10, max_phrases: int = 5,
) -> DataFrame:
    """``enrich_reviews`` with the lexicon (``word``, ``valence``) and the stop list (``word``) as tables of any size.

    Tables of up to ``lexicon.SENT_HASH_BYTES`` are sent to the tasks as hashes, which clean and count the words of a
    text once, where it is. What comes from a larger one is joined back by the key and a hash of the text, so rows that
    repeat a key keep what belongs to their own text; a null key is a key.
    """
    body = F.col(text_column)
    has_text = F.coalesce(F.length(body) > 0, F.lit(False))
    threshold, inclusive = (0.05, True) if mode == "compound" else (0.1, False)
    lexicon, stop_words = word_table(lexicon, "word", "valence"), word_table(stop_words)
    valences, stops = hashed_words(lexicon), hashed_words(stop_words)

    def where_text(value: Column) -> Column:
        return F.when(has_text, value)

    rows, found = reviews, []
    if stops:
        counted, f = F.arrow_udf(by_chunks(enriched, stops, valences or Words([]), max_keywords, max_phrases), _FOUND), F.col("__found")
        rows = rows.withColumn("__found", counted(body)).withColumns({
            "__score": polarity(f["total"], f["hits"], mode), "keywords": f["keywords"], "phrases": f["phrases"]}).drop("__found")
    else:
        found += [
            (table_keywords(reviews, stop_words, key, text_column, max_keywords), ["keywords"]),
            (table_phrases(reviews, stop_words, key, text_column, max_phrases), ["phrases"])]
    if not (stops and valences):
        totals = lexicon_totals(reviews, lexicon, key, text_column)
        found.append((totals.withColumn("__score", polarity(F.col("total"), F.col("hits"), mode)).drop("total", "hits"), ["__score"]))
        rows = _joined_back(rows.drop("__score"), found, key, text_column)
    none = F.array().cast("array<string>")
    return rows.withColumns({
        "sentiment_score": where_text(F.coalesce("__score", F.lit(0.0))),
        "keywords": where_text(F.coalesce("keywords", none)),
        "phrases": where_text(F.coalesce("phrases", none)),
        "word_count": where_text(text.word_count(body)),
        "character_count": where_text(text.character_count(body)),
    }).drop("__score").withColumn("sentiment_label", sentiment.label(F.col("sentiment_score"), threshold, inclusive))


def _joined_back(rows: DataFrame, found: Sequence[tuple[DataFrame, list[str]]], key: Sequence[str], text_column: str) -> DataFrame:
    rows = rows.withColumn("__hash", F.xxhash64(text_column))
    for frame, names in found:
        side = frame.select(*[F.col(c).alias(f"__{c}_key") for c in key], F.col("text_hash").alias("__text_hash"), *names)
        same = F.col("__hash") == F.col("__text_hash")
        for c in key:
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}_key"))
        rows = rows.join(side, same, "left").drop("__text_hash", *[f"__{c}_key" for c in key])
    return rows.drop("__hash")


def process_new_reviews(reviews: DataFrame, as_of: Column, **kwargs) -> DataFrame:
    """Enrich the reviews not yet processed and stamp them; reviews without text are stamped too."""
    return enrich_reviews(reviews.filter(F.col("processed_at").isNull()), **kwargs).withColumn("processed_at", as_of)


def rating_sentiment_columns(reviews: DataFrame, text_column: str = "review_text") -> DataFrame:
    """Score, label, confidence, method and simple keywords of landed place reviews."""
    body = F.col(text_column)
    s = F.col("__sentiment")
    return reviews.withColumn("__sentiment", sentiment.rating_sentiment(F.col("rating"), body)).withColumns({
        "sentiment_score": s["score"], "sentiment_label": s["label"],
        "sentiment_confidence": s["confidence"], "sentiment_method": s["method"],
        "keywords": F.when(F.length(body) > 0, text.simple_keywords(body)).otherwise(F.array().cast("array<string>")),
    }).drop("__sentiment")
