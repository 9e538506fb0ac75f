"""Lexicon and stop list as tables: equal to the column functions, whatever the size of the table."""

import pytest
from pyspark.sql import functions as F

from streetlens.functions import sentiment
from streetlens.operators import lexicon
from streetlens.operators.enrich import enrich_reviews, enrich_with_tables

WORDS = {"good": 1.0, "bad": -1.0, "great": 2.5, "the": 0.25}
STOPS = ["the", "and", "was"]
TEXTS = ["The food was good and the staff was GOOD", "bad bad bad", "no match here", "", None, "great food, great food; the great food", "good " * 3000, "  "]


@pytest.fixture(scope="module")
def reviews(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)]
    rows += [rows[0], (1, "good", "y"), (None, "no id good", "z"), (None, "no id bad", "z")]
    return spark.createDataFrame(rows, "review_id int, review_text string, key string").repartition(3)


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([*WORDS.items(), (None, 5.0), ("food", None)], "word string, valence double")


@pytest.fixture(scope="module")
def stops(spark):
    return spark.createDataFrame([(w,) for w in [*STOPS, None, "the"]], "word string")


@pytest.mark.parametrize("sent", [250_000, 0])
@pytest.mark.parametrize("mode", ["compound", "mean"])
def test_scores_equal_the_column_form(reviews, words, mode, sent, monkeypatch):
    monkeypatch.setattr(lexicon, "SENT_WORDS", sent)
    got = {(r.review_id, round(r.score, 9)) for r in lexicon.lexicon_scores(reviews, words, mode=mode).collect()}
    want = reviews.select("review_id", sentiment.lexicon_score(F.col("review_text"), WORDS, mode).alias("s")).collect()
    assert got == {(r.review_id, round(r.s, 9)) for r in want}


def test_a_repeated_word_has_its_mean(spark, reviews):
    twice = spark.createDataFrame([("bad", -1.0), ("bad", -3.0)], "word string, valence double")
    scores = {r.review_id: r.score for r in lexicon.lexicon_scores(reviews.filter("review_id = 1 and key = 'x'"), twice, mode="mean").collect()}
    assert scores == {1: -2.0}


def test_the_plan_does_not_hold_the_words(spark, reviews):
    def plan(n):
        table = spark.range(n).select(F.concat(F.lit("word"), "id").alias("word"), F.lit(1.0).alias("valence"))
        return len(lexicon.lexicon_scores(reviews, table)._jdf.queryExecution().optimizedPlan().toString())
    assert abs(plan(100_000) - plan(10)) < 200


@pytest.mark.parametrize("sent", [250_000, 0])
def test_enrichment_equals_the_column_form(reviews, words, stops, sent, monkeypatch):
    monkeypatch.setattr(lexicon, "SENT_WORDS", sent)
    columns = ["review_id", "key", "review_text", "sentiment_score", "sentiment_label", "keywords", "phrases", "word_count", "character_count"]
    got = enrich_with_tables(reviews, words, stops).select(columns).collect()
    want = enrich_reviews(reviews, WORDS, stop_words=STOPS).select(columns).collect()

    def shown(rows):
        return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)
    assert shown(got) == shown(want)


def test_empty_tables(reviews, words, stops):
    assert lexicon.lexicon_scores(reviews.limit(0), words).collect() == []
    assert {r.score for r in lexicon.lexicon_scores(reviews, words.limit(0)).collect()} == {0.0}
    keywords = {tuple(r.keywords) for r in lexicon.table_keywords(reviews.filter("review_id = 1 and key = 'x'"), stops.limit(0)).collect()}
    assert keywords == {("bad",)}


@pytest.mark.parametrize("sent", [1 << 20, 40, 16, 0])
def test_words_are_exchanged_for_large_tables_only(reviews, words, stops, sent, monkeypatch):
    # 40 bytes hold the stop list, not the lexicon; of that two words are sent then, of 16 bytes one
    monkeypatch.setattr(lexicon, "SENT_HASH_BYTES", sent)
    monkeypatch.setattr(lexicon, "SENT_WORDS", 0)
    scores = lexicon.lexicon_scores(reviews, words)
    full = enrich_with_tables(reviews, words, stops)
    want = {(r.review_id, round(r.s, 9)) for r in reviews.select("review_id", sentiment.lexicon_score(F.col("review_text"), WORDS).alias("s")).collect()}
    assert {(r.review_id, round(r.score, 9)) for r in scores.collect()} == want
    shown = [sorted(map(str, df.select("review_id", "key", F.round("sentiment_score", 9), "keywords", "phrases").collect()))
             for df in (full, enrich_reviews(reviews, WORDS, stop_words=STOPS))]
    assert shown[0] == shown[1]
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (scores, full)]
    assert ["Join" in plan for plan in plans] == [sent < 1 << 20] * 2
    # no text is taken apart into rows of words
    assert "regexp_replace" not in plans[0]
